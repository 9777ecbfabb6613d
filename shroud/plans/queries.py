"""The registered queries: one DataFrame plan per operator of the inventory.

Each function takes (spark, sf_dir) and returns a DataFrame whose column names
equal those of the matching DuckDB oracle in ``shroud.plans.oracle``.  Queries
whose plan reads the predictions more than once store them first, and the
streams run to their end; all others start no job before their result is asked for.
The corpus is ``documents`` plus the planted corpus derived from ``orders``,
``customer``, ``nation``, ``region`` and ``supplier``; all work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions import patterns as P
from shroud.functions.surrogate import consistency_key, surrogate
from shroud.functions.text import digits_only_sql, guard_sql, locate_matches_sql, luhn_ok_sql, normalize, regex_matches_sql, strip
from shroud.operators import detect as D
from shroud.operators import evaluate as E
from shroud.operators import hybrid as H
from shroud.operators import redact as R
from shroud.operators import resolve as V
from shroud.session import fresh_path, stored
from shroud.sources import corpus as C
from shroud.sources import segments as S

SPAN_OUT = ["doc_id", "segment_index", "start", "end", "entity_type", "text", "score", "source", "prio"]


# --- shared building blocks -----------------------------------------------------

def docs(spark, sf):
    return C.corpus(spark, sf)


def segments(spark, sf):
    return S.segment_all(docs(spark, sf))


def texts(spark, sf):
    return S.segment_texts(docs(spark, sf))


def dictionary(spark, sf):
    return D.dictionary_table(spark, sf)


def candidates(spark, sf):
    return H.candidate_spans(texts(spark, sf), dictionary(spark, sf))


def resolved(spark, sf):
    return H.hybrid_spans(texts(spark, sf), dictionary(spark, sf))


def preds(spark, sf):
    return H.predictions(resolved(spark, sf))


def pairs(spark, sf):
    """Replacement pairs, stored: a literal pass reads them once for all documents and once for the blocks of long ones."""
    return stored(R.replacement_pairs(preds(spark, sf)))


def found(spark, sf, keep=()):
    """Segments with the predictions in them, stored."""
    seg = segments(spark, sf).select("doc_id", "segment_index", *keep, "text") if keep else texts(spark, sf)
    return stored(H.segment_spans(seg, dictionary(spark, sf)).withColumn("spans", H.predicted()))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def _spans_out(df: DataFrame, cols=SPAN_OUT) -> DataFrame:
    return _long(df.select(*cols), *[c for c in ("segment_index", "start", "end", "prio") if c in cols])


# --- A: sources, segments, sinks ----------------------------------------------

def q_src_documents(spark, sf):
    parts = []
    for name in ("documents", "planted", "pages", "conversations"):
        df = C.corpus(spark, sf, (name,))
        parts.append(df.select(F.lit(name).alias("source"), "doc_id",
                               F.length("text").cast("long").alias("n_chars"),
                               F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_segments_body(spark, sf):
    return _long(S.segment_body(docs(spark, sf)).select("doc_id", "segment_index", "paragraph_index", "text"),
                 "segment_index", "paragraph_index")


CELL_COLUMNS = [("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("supplier", "s_suppkey", ["s_name"]),
                ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"])]


def q_segments_cells(spark, sf):
    """A3: the cells of the planted documents' row (table 0), and every cell of three relational tables."""
    out = _long(S.segment_cells(docs(spark, sf)), "segment_index", "table_index", "row_index", "cell_index")
    keys = ["doc_id", "segment_index", "table_index", "row_index", "cell_index", "text"]
    out = out.select(*keys)
    for k, (name, key, columns) in enumerate(CELL_COLUMNS, 1):
        cells = S.table_cells(C.read_table(spark, sf, name), key, columns, k)
        out = out.unionByName(_long(cells.select(*keys), "segment_index", "table_index", "row_index", "cell_index"))
    return out


def q_segments_all(spark, sf):
    return _long(segments(spark, sf), "segment_index", "paragraph_index", "table_index", "row_index", "cell_index")


def q_predictions(spark, sf):
    return _spans_out(preds(spark, sf), ["doc_id", "segment_index", "start", "end", "entity_type", "text", "score", "source"])


def q_redacted_documents(spark, sf):
    """Body and cells rewritten and put back; cells as one tab-separated string."""
    rebuilt = R.rebuild_documents(docs(spark, sf), R.redact_found(found(spark, sf, ("paragraph_index", "cell_index")), keep=("paragraph_index", "cell_index")))
    return rebuilt.select("doc_id", "text", F.array_join("cells", "\t").alias("cells"))


# --- B: scalar functions and filters ------------------------------------------

def q_normalize_values(spark, sf):
    c = candidates(spark, sf)
    return _long(c.select("doc_id", "segment_index", "start", "entity_type",
                          strip("text").alias("stripped"), normalize("text").alias("norm")),
                 "segment_index", "start")


def q_label_map(spark, sf):
    raw = D.span_rows(texts(spark, sf), D.scored_finder()).withColumn("label", F.col("entity_type"))
    mapped = D.map_labels(raw, D.label_table(spark))
    return _long(mapped.select("doc_id", "segment_index", "start", "end", "label", "entity_type", "score"),
                 "segment_index", "start", "end")


def q_score_threshold(spark, sf):
    sc = D.span_rows(texts(spark, sf), D.scored_finder())
    return _long(sc.select("doc_id", "segment_index", "start", "end",
                           F.col("entity_type").alias("label"), "score"),
                 "segment_index", "start", "end")


def _filter_report(flag):
    def q(spark, sf):
        c = candidates(spark, sf)
        return c.groupBy("entity_type", "source").agg(
            F.count(F.lit(1)).alias("n_in"),
            F.sum(F.when(F.expr(flag), 1).otherwise(0)).cast("long").alias("n_removed"))
    return q


q_blocklist_filter = _filter_report(H.blocklist_sql("text"))
q_short_name_filter = _filter_report(H.short_name_sql("entity_type", "text"))
q_numeric_dob_filter = _filter_report(H.numeric_dob_sql("entity_type", "source", "text"))


def q_luhn_valid_cards(spark, sf):
    """B9-B10 over every card-shaped candidate (before the Luhn filter)."""
    seg = texts(spark, sf)
    etype, pat, ic = P.REGEX_PATTERNS[3]
    jp = P.java_pattern(pat, ic)
    guard = guard_sql("text", P.REGEX_GUARDS[etype])
    m = seg.select("doc_id", "segment_index", "text", F.expr(regex_matches_sql("text", jp, guard)).alias("_m"))
    loc = m.select("doc_id", "segment_index", F.explode_outer(F.expr(locate_matches_sql("text", "_m", jp))).alias("c"))
    loc = loc.where(F.col("c").isNotNull())
    return _long(loc.select("doc_id", "segment_index", F.col("c.start").alias("start"), F.col("c.text").alias("text"),
                            F.expr(luhn_ok_sql(digits_only_sql("c.text"))).alias("luhn_ok")), "segment_index", "start")


def q_span_text_check(spark, sf):
    """substring(segment, start, end) equals the span text for every resolved span."""
    r = resolved(spark, sf)
    seg = texts(spark, sf).select("doc_id", "segment_index", F.col("text").alias("seg_text"))
    j = r.join(seg, ["doc_id", "segment_index"])
    ok = F.substring("seg_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return j.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"),
                                        F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("n_ok"))


# --- C: detectors -------------------------------------------------------------

def _detect_one(etype):
    def q(spark, sf):
        return _spans_out(D.span_rows(texts(spark, sf), D.regex_finder([etype])), ["doc_id", "segment_index", "start", "end", "text"])
    return q


q_detect_email = _detect_one("EMAIL")
q_detect_ssn = _detect_one("SSN")
q_detect_ip = _detect_one("IP_ADDRESS")
q_detect_credit_card = _detect_one("CREDIT_CARD")
q_detect_dob = _detect_one("DATE_OF_BIRTH")
q_detect_phone = _detect_one("PHONE")

REGEX_OUT = ["doc_id", "segment_index", "start", "end", "entity_type", "text", "prio"]


def q_regex_spans(spark, sf):
    return _spans_out(D.span_rows(texts(spark, sf), D.regex_finder()), REGEX_OUT)


def q_gazetteer_spans(spark, sf):
    return _spans_out(D.detect_gazetteer(texts(spark, sf), dictionary(spark, sf)), REGEX_OUT)


def q_scored_spans(spark, sf):
    sc = D.span_rows(texts(spark, sf), D.scored_finder())
    return _spans_out(D.map_labels(sc, D.label_table(spark)), REGEX_OUT[:-1] + ["score", "prio"])


def q_spans_union(spark, sf):
    return _spans_out(candidates(spark, sf))


def q_hybrid_spans(spark, sf):
    return _spans_out(resolved(spark, sf))


def q_detect_distinct(spark, sf):
    spans = H.detect_distinct(texts(spark, sf), D.detect_regex)
    return _spans_out(D.explode_spans(spans), REGEX_OUT)


def q_plugin_spans(spark, sf):
    out = D.detect_plugin(texts(spark, sf), D.secret_factory)
    return _spans_out(out, ["doc_id", "segment_index", "start", "end", "entity_type", "text"])


def q_web_spans(spark, sf):
    """C11 over the other text sources: pages (markup and all, one segment a line) and conversations."""
    seg = S.segment_texts(C.corpus(spark, sf, ("pages", "conversations")))
    return _spans_out(H.hybrid_spans(seg, dictionary(spark, sf)))


# --- D: overlap logic, joins --------------------------------------------------

def q_overlap_pairs(spark, sf):
    pairs = V.overlap_pairs(H.filter_spans(candidates(spark, sf)))
    return _long(pairs, "segment_index", "a_start", "a_end", "b_start", "b_end")


def q_resolve_overlaps(spark, sf):
    """D2 over the sorted span table."""
    return _spans_out(V.resolve_segment_spans(H.filter_spans(candidates(spark, sf))))


def q_overlap_islands(spark, sf):
    isl = V.overlap_islands(H.filter_spans(candidates(spark, sf)))
    return _long(isl.select("doc_id", "segment_index", "start", "end", "entity_type", "prio", "island"),
                 "segment_index", "start", "end", "prio", "island")


def q_replacement_hits(spark, sf):
    return _long(R.replacement_hits(texts(spark, sf), pairs(spark, sf)), "segment_index")


def q_first_occurrence(spark, sf):
    from pyspark.sql import Window
    p = preds(spark, sf)
    w = Window.partitionBy("doc_id", "text").orderBy("segment_index", "start")
    first = p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return _long(first.select("doc_id", F.col("text").alias("original"), "segment_index", "start", "entity_type"),
                 "segment_index", "start")


# --- E: surrogates and rewriting ------------------------------------------------

def q_consistency_keys(spark, sf):
    p = preds(spark, sf)
    return _long(p.select("doc_id", "segment_index", "start",
                          consistency_key("entity_type", "text").alias("key")), "segment_index", "start")


def q_surrogates(spark, sf):
    p = preds(spark, sf).select("entity_type", F.col("text").alias("original")).distinct()
    return p.select("entity_type", "original", surrogate("entity_type", "original").alias("surrogate"))


def _surrogate_of(etype):
    def q(spark, sf):
        p = preds(spark, sf).where(F.col("entity_type") == etype).select(F.col("text").alias("original")).distinct()
        return p.select("original", surrogate(f"'{etype}'", "original").alias("surrogate"))
    return q


q_surrogate_person = _surrogate_of("PERSON")
q_surrogate_email = _surrogate_of("EMAIL")
q_surrogate_phone = _surrogate_of("PHONE")
q_surrogate_org = _surrogate_of("ORG")
q_surrogate_address = _surrogate_of("ADDRESS")
q_surrogate_ssn = _surrogate_of("SSN")
q_surrogate_card = _surrogate_of("CREDIT_CARD")
q_surrogate_dob = _surrogate_of("DATE_OF_BIRTH")
q_surrogate_ip = _surrogate_of("IP_ADDRESS")


def q_surrogate_fallback(spark, sf):
    """E13 over raw scored labels: labels that are not entity types get a placeholder."""
    sc = D.span_rows(texts(spark, sf), D.scored_finder())
    v = sc.select(F.col("entity_type").alias("label"), F.col("text").alias("original")).distinct()
    return v.select("label", "original", surrogate("label", "original").alias("surrogate"))


def q_replacement_pairs(spark, sf):
    return _long(R.replacement_pairs(preds(spark, sf)), "first_segment", "first_start")


def q_cache_size(spark, sf):
    return R.cache_size(R.replacement_pairs(preds(spark, sf)))


def q_surrogates_doc_scope(spark, sf):
    return _long(R.replacement_pairs(preds(spark, sf), scope="document"), "first_segment", "first_start")


def q_replace_first(spark, sf):
    hits = R.segment_pair_hits(texts(spark, sf), pairs(spark, sf))
    return _long(hits.select("doc_id", "segment_index", "original",
                             F.expr(R.replace_first_sql("text", "original", "surrogate")).alias("replaced")),
                 "segment_index")


def q_redact_literal(spark, sf):
    return _long(R.redact_literal(texts(spark, sf), pairs(spark, sf)).select("doc_id", "segment_index", "redacted"),
                 "segment_index")


def q_redact_spans(spark, sf):
    return _long(R.redact_found(found(spark, sf)).select("doc_id", "segment_index", "redacted"), "segment_index")


def q_leak_audit(spark, sf):
    return _long(R.leak_audit(texts(spark, sf), pairs(spark, sf)), "segment_index")


def q_leak_redetect(spark, sf):
    """All detectors once more, over the rewritten texts."""
    known = pairs(spark, sf)
    rewritten = stored(R.redact_literal(texts(spark, sf), known).select("doc_id", "segment_index", F.col("redacted").alias("text")))
    again = H.predictions(H.hybrid_spans(rewritten, dictionary(spark, sf)))
    return _long(R.leaks_detected(again, known), "segment_index")


# --- F: aggregations and evaluation ---------------------------------------------

def q_entity_counts(spark, sf):
    return preds(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def q_entity_summary(spark, sf):
    p = preds(spark, sf)
    g = p.rollup("entity_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("entity_type").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("entity_type")).alias("entity_type"),
                    "n").orderBy(F.col("entity_type") == "TOTAL", "entity_type")


def q_corpus_stats(spark, sf):
    d = docs(spark, sf)
    seg = texts(spark, sf)
    p = preds(spark, sf)
    n_seg = seg.select(F.count(F.lit(1))).scalar()
    n_uniq = p.select(F.count_distinct("doc_id", "text")).scalar()
    return d.agg(F.count(F.lit(1)).alias("n_documents")).select(
        "n_documents", n_seg.alias("n_segments"), n_uniq.alias("n_unique_values"))


def _gt_and_preds(spark, sf):
    """Ground truth of the planted documents, and every prediction of the corpus: what the detectors find in prose, which
    nobody planted, counts as false."""
    return C.planted_truth(spark, sf), preds(spark, sf)


def q_eval_types(spark, sf):
    return E.eval_types(*_gt_and_preds(spark, sf))


def _eval_col(col):
    def q(spark, sf):
        return E.eval_counts(*_gt_and_preds(spark, sf)).select("entity_type", col)
    return q


q_eval_tp = _eval_col("tp")
q_eval_fp = _eval_col("fp")
q_eval_fn = _eval_col("fn")


def q_eval_metrics(spark, sf):
    return E.eval_metrics(*_gt_and_preds(spark, sf))


def q_eval_annotated(spark, sf):
    """F6-F10 by place, and over the annotated documents only."""
    gt, p = _gt_and_preds(spark, sf)
    return E.eval_metrics(gt, p, match="offset", annotated=C.corpus(spark, sf, ("planted",)))


def q_eval_report(spark, sf):
    return E.eval_report(E.eval_metrics(*_gt_and_preds(spark, sf)))


# --- A5/A6 and H: records and streams -------------------------------------------

def q_json_roundtrip(spark, sf):
    """A6 then A5: predictions written as JSON to the shared folder and read back."""
    from shroud.sources.records import read_records, write_records

    path = fresh_path(spark, "predictions-json")
    write_records(q_predictions(spark, sf), path)
    return read_records(spark, path)


def q_stream_redact(spark, sf):
    from shroud.streaming.stream import redact_stream

    return redact_stream(spark, sf, dictionary(spark, sf))


def q_stream_entity_counts(spark, sf):
    from shroud.streaming.stream import entity_count_stream

    return entity_count_stream(spark, sf)


QUERIES = {
    "src_documents": q_src_documents,
    "segments_body": q_segments_body,
    "segments_cells": q_segments_cells,
    "segments_all": q_segments_all,
    "predictions": q_predictions,
    "redacted_documents": q_redacted_documents,
    "normalize_values": q_normalize_values,
    "label_map": q_label_map,
    "score_threshold": q_score_threshold,
    "blocklist_filter": q_blocklist_filter,
    "short_name_filter": q_short_name_filter,
    "numeric_dob_filter": q_numeric_dob_filter,
    "luhn_valid_cards": q_luhn_valid_cards,
    "span_text_check": q_span_text_check,
    "detect_email": q_detect_email,
    "detect_ssn": q_detect_ssn,
    "detect_ip": q_detect_ip,
    "detect_credit_card": q_detect_credit_card,
    "detect_dob": q_detect_dob,
    "detect_phone": q_detect_phone,
    "regex_spans": q_regex_spans,
    "gazetteer_spans": q_gazetteer_spans,
    "scored_spans": q_scored_spans,
    "spans_union": q_spans_union,
    "hybrid_spans": q_hybrid_spans,
    "detect_distinct": q_detect_distinct,
    "plugin_spans": q_plugin_spans,
    "web_spans": q_web_spans,
    "overlap_pairs": q_overlap_pairs,
    "resolve_overlaps": q_resolve_overlaps,
    "overlap_islands": q_overlap_islands,
    "replacement_hits": q_replacement_hits,
    "first_occurrence": q_first_occurrence,
    "consistency_keys": q_consistency_keys,
    "surrogates": q_surrogates,
    "surrogate_person": q_surrogate_person,
    "surrogate_email": q_surrogate_email,
    "surrogate_phone": q_surrogate_phone,
    "surrogate_org": q_surrogate_org,
    "surrogate_address": q_surrogate_address,
    "surrogate_ssn": q_surrogate_ssn,
    "surrogate_card": q_surrogate_card,
    "surrogate_dob": q_surrogate_dob,
    "surrogate_ip": q_surrogate_ip,
    "surrogate_fallback": q_surrogate_fallback,
    "replacement_pairs": q_replacement_pairs,
    "cache_size": q_cache_size,
    "surrogates_doc_scope": q_surrogates_doc_scope,
    "replace_first": q_replace_first,
    "redact_literal": q_redact_literal,
    "redact_spans": q_redact_spans,
    "leak_audit": q_leak_audit,
    "leak_redetect": q_leak_redetect,
    "entity_counts": q_entity_counts,
    "entity_summary": q_entity_summary,
    "corpus_stats": q_corpus_stats,
    "eval_types": q_eval_types,
    "eval_tp": q_eval_tp,
    "eval_fp": q_eval_fp,
    "eval_fn": q_eval_fn,
    "eval_metrics": q_eval_metrics,
    "eval_annotated": q_eval_annotated,
    "eval_report": q_eval_report,
    "json_roundtrip": q_json_roundtrip,
    "stream_redact": q_stream_redact,
    "stream_entity_counts": q_stream_entity_counts,
}
