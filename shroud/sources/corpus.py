"""Corpus sources: text tables as (doc_id, text, cells) rows.

* ``documents`` - the driver's prose table, one document per row.
* ``planted_documents`` - one synthetic document per order, built from
  ``orders`` x ``customer`` x ``nation`` x ``region`` x ``supplier`` with known PII
  values; ``planted_truth`` derives the ground truth from the same expressions.
  Planted documents get ``doc_id = -1 - o_orderkey`` so they never collide with
  prose documents.
* ``pages`` / ``conversations`` - further text sources (one segment per page or turn).

The DuckDB oracle builds the planted text with the same expressions
(``shroud.plans.oracle``); both sides must change together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.sources.tables import read_table
from shroud.functions.text import luhn_check_digit_sql
from shroud.session import dealt, splits_of

# --- fixed values: month abbreviations used by the planted dates ---------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

CELLS_TYPE = "array<string>"
# Sources number their documents on their own; these offsets keep them apart in one corpus.
PAGES_FROM, TURNS_FROM = 10**15, 2 * 10**15
# Fixed value: zero to nine in Arabic-Indic digits, for a planted card number
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
JCB_DIGITS = "35٣٠١١١٣٣٣٠٠٠٠٠٦"


def _scanned(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """doc_id and text of a table, dealt out, and no cells."""
    scan = read_table(spark, sf_dir, name).select(*columns)
    return dealt(scan, splits_of(scan)).withColumn("cells", F.lit(None).cast(CELLS_TYPE))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "documents", "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "pages", (F.col("page_id") + PAGES_FROM).alias("doc_id"), F.col("html").alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation turn; doc_id = TURNS_FROM + conv_id * 1000000 + turn."""
    return _scanned(spark, sf_dir, "conversations", (F.col("conv_id") * 1000000 + F.col("turn") + TURNS_FROM).alias("doc_id"), "text")


def _lp(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _planted_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined with their customer, nation, region and a supplier, dealt out before any text is made of them.

    How each join runs is left to the planner's size statistics.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n_supp = supplier.select(F.count(F.lit(1))).scalar()
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(supplier, F.col("s_suppkey") == F.col("o_orderkey") % n_supp)
        .select("o_orderkey", "o_custkey", "o_orderpriority", "c_name", "c_mktsegment",
                "n_name", "r_name", "s_name")
    )
    return dealt(joined, splits_of(orders))


def _planted_values(df: DataFrame) -> DataFrame:
    """Add every planted value and its validity flag as a column (one projection)."""
    k = F.col("o_custkey")
    o = F.col("o_orderkey")
    months = F.array(*[F.lit(m) for m in MONTHS])
    yyyy = (1940 + k % 60).cast("string")
    mm = _lp(1 + k % 12, 2)
    dd = _lp(1 + k % 28, 2)
    payload = F.concat(F.lit("4"), _lp(k * 7919 % 10000000, 7), _lp(o % 10000000, 7))
    check = F.expr(luhn_check_digit_sql("cast(_payload as bigint)"))
    card_ok = o % 5 != 0
    cols = {
        "email": F.concat(F.lit("customer"), k.cast("string"), F.lit("@mail"), (k % 7).cast("string"),
                          F.lit(".example.com")),
        "phone": F.concat(F.lit("+1 (2"), _lp(k % 100, 2), F.lit(") 555-"), _lp(k % 10000, 4)),
        "ssn": F.concat(
            F.when(o % 10 == 0, F.lit("000")).otherwise(_lp(1 + k % 665, 3)), F.lit("-"),
            F.when(o % 10 == 5, F.lit("00")).otherwise(_lp(1 + k % 99, 2)), F.lit("-"),
            _lp(1 + k % 9999, 4)),
        "ssn_ok": ~(o % 10).isin(0, 5),
        "dob": F.when(k % 3 == 0, F.concat(F.lit("DOB: "), mm, F.lit("/"), dd, F.lit("/"), yyyy))
        .when(k % 3 == 1, F.concat(F.lit("Born "), F.element_at(months, (k % 12 + 1).cast("int")),
                                   F.lit(" "), (1 + k % 28).cast("string"), F.lit(", "), yyyy))
        .otherwise(F.concat(F.lit("Date of Birth - "), yyyy, F.lit("-"), mm, F.lit("-"), dd)),
        "dob_tail": F.when(k % 3 == 0, F.lit(" noted.")).when(k % 3 == 1, F.lit(" in town."))
        .otherwise(F.lit(" recorded.")),
        "card": F.concat(F.col("_payload"), ((check + F.when(card_ok, 0).otherwise(1)) % 10).cast("string")),
        "card_ok": card_ok,
        "jcb": o % 7 == 0,
        "ip": F.concat(F.lit("10."), (k % 256).cast("string"), F.lit("."), (o % 256).cast("string"), F.lit("."),
                       ((k + o) % 256).cast("string")),
    }
    return df.select("*", payload.alias("_payload")).select("*", *[c.alias(n) for n, c in cols.items()])


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order; lines 0-6, line 3 blank; one table row of cells."""
    v = _planted_values(_planted_base(spark, sf_dir))
    lines = [
        F.concat(F.lit("Order placed by "), F.col("c_name"), F.lit(" of "), F.col("n_name"), F.lit(" in "),
                 F.col("r_name"), F.lit(", via "), F.col("s_name"), F.lit(" for the Company, per QX and the Board.")),
        F.concat(F.lit("Contact "), F.col("email"), F.lit(" or "), F.col("phone"),
                 F.lit(" today, not 555.1234567.")),
        F.concat(F.lit("SSN "), F.col("ssn"), F.lit(" on file.")),
        F.lit(""),
        F.concat(F.col("dob"), F.col("dob_tail")),
        F.concat(F.lit("Card "), F.col("card"), F.lit(" charged."),
                 F.when(F.col("jcb"), F.lit(f" Also {JCB_DIGITS}.")).otherwise(F.lit(""))),
        F.concat(F.lit("Login from "), F.col("ip"), F.lit(" ok, not 10.300.1.1, repeat "), F.col("c_name"),
                 F.lit(" and "), F.col("c_name"), F.lit(".")),
    ]
    return v.select(
        (-1 - F.col("o_orderkey")).alias("doc_id"),
        F.concat_ws("\n", *lines).alias("text"),
        F.array(F.col("c_name"), F.col("n_name"), F.col("c_mktsegment"), F.col("o_orderpriority")).alias("cells"),
    )


def planted_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the planted corpus: (doc_id, segment_index, start, end, entity_type, text).

    Body segments are 0..5 (paragraph 3 is blank); offsets are 0-based code points.
    """
    v = _planted_values(_planted_base(spark, sf_dir)).select("*", (-1 - F.col("o_orderkey")).alias("doc_id"))
    L = F.length
    p0_name = F.lit(len("Order placed by "))
    p0_nation = p0_name + L("c_name") + len(" of ")
    p0_region = p0_nation + L("n_name") + len(" in ")
    p0_supp = p0_region + L("r_name") + len(", via ")
    p1_phone = F.lit(len("Contact ")) + L("email") + len(" or ")
    p5_name1 = F.lit(len("Login from ")) + L("ip") + len(" ok, not 10.300.1.1, repeat ")
    p5_name2 = p5_name1 + L("c_name") + len(" and ")
    rows = [
        (0, p0_name, "PERSON", F.col("c_name"), F.lit(True)),
        (0, p0_nation, "ADDRESS", F.col("n_name"), F.lit(True)),
        (0, p0_region, "ADDRESS", F.col("r_name"), F.lit(True)),
        (0, p0_supp, "ORG", F.col("s_name"), F.lit(True)),
        (1, F.lit(len("Contact ")), "EMAIL", F.col("email"), F.lit(True)),
        (1, p1_phone, "PHONE", F.col("phone"), F.lit(True)),
        (2, F.lit(len("SSN ")), "SSN", F.col("ssn"), F.col("ssn_ok")),
        (3, F.lit(0), "DATE_OF_BIRTH", F.col("dob"), F.lit(True)),
        (4, F.lit(len("Card ")), "CREDIT_CARD", F.col("card"), F.col("card_ok")),
        (4, F.lit(len("Card ")) + L("card") + len(" charged. Also "), "CREDIT_CARD", F.lit(JCB_DIGITS), F.col("jcb")),
        (5, F.lit(len("Login from ")), "IP_ADDRESS", F.col("ip"), F.lit(True)),
        (5, p5_name1, "PERSON", F.col("c_name"), F.lit(True)),
        (5, p5_name2, "PERSON", F.col("c_name"), F.lit(True)),
    ]
    structs = F.array(*[
        F.struct(F.lit(seg).alias("segment_index"), start.cast("int").alias("start"),
                 (start + L(val)).cast("int").alias("end"), F.lit(et).alias("entity_type"),
                 val.alias("text"), ok.alias("ok"))
        for seg, start, et, val, ok in rows
    ])
    return (
        v.select("doc_id", F.explode(structs).alias("g"))
        .where(F.col("g.ok"))
        .select("doc_id", "g.segment_index", "g.start", "g.end", "g.entity_type", "g.text")
    )


def corpus(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] = ("documents", "planted")) -> DataFrame:
    """The text corpus the detectors run over."""
    makers = {
        "documents": documents,
        "planted": planted_documents,
        "pages": pages,
        "conversations": conversations,
    }
    out = None
    for s in sources:
        df = makers[s](spark, sf_dir)
        out = df if out is None else out.unionByName(df)
    return out
