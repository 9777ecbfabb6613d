"""What keeps the detectors' work spread and small: dealt rows, one Python pass, a filter of fixed size for a large dictionary."""

import random

import pytest
from conftest import seg_df
from pyspark.sql import functions as F

from shroud.functions import patterns as P
from shroud.functions.text import luhn_check_digit_sql, luhn_passes
from shroud.operators import detect as D
from shroud.session import stored
from shroud.sources import corpus as C
from shroud.sources import segments as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("source", ["documents", "planted", "pages", "conversations"])
def test_a_file_of_one_row_group_keeps_all_tasks_busy(spark, source):
    segments = S.segment_all(C.corpus(spark, SF, (source,)))
    assert segments.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_truth_is_dealt_too(spark):
    assert C.planted_truth(spark, SF).select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_detectors_are_one_pass_that_returns_no_text(spark):
    segs = stored(seg_df(spark, ["a@b.co 123-45-6789 call +1 212 555 0199", "", None, "DOB:\x1c1/2/1990 at 12 Oak Street"]))
    for finder, nested in ((D.regex_finder(), D.detect_regex(segs)), (D.scored_finder(), D.detect_scored(segs, out="spans"))):
        rows = D.span_rows(segs, finder)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and "split(" not in plan and plan.count("MapInArrow") == 1
        got = sorted(tuple(r) for r in rows.collect())
        assert got and got == sorted(tuple(r) for r in D.explode_spans(nested).collect())


def test_scored_rules_and_their_guards(spark):
    text = "call +1 212 555 0199, born 1980, year 1999, 12 Oak Street, ssn 123456789, 4111 1111 1111 1111, 4111 1111 1111 1112"
    got = {(r.entity_type, r.text): r.score for r in D.span_rows(seg_df(spark, [text]), D.scored_finder()).collect()}
    assert got == {("PHONE_NUMBER", "+1 212 555 0199"): 0.5 + 0.3, ("DATE_TIME", "1980"): 0.5, ("DATE_TIME", "1999"): 0.5,
                   ("LOCATION", "12 Oak Street"): 0.7, ("US_SSN", "123456789"): 0.05 + 0.6, ("CREDIT_CARD", "4111 1111 1111 1111"): 1.0}
    assert D._scored_guard(r"[0-9]*x") == D._scored_guard(r"a|[0-9]") == D._scored_guard("(?:[0-9]|x)") == ("contains", "")
    assert [D._scored_guard(r[1])[1] for r in P.SCORED_RECOGNIZERS] == ["@"] + ["[0-9]"] * 7 + [""]


def test_luhn():
    assert luhn_passes("4111 1111 1111 1111") and not luhn_passes("4111111111111112") and not luhn_passes("0" * 12)


def test_a_filter_of_any_size_gives_the_same_spans(spark, monkeypatch):
    """64 bits let nearly everything through, the join then tells; the whole filter lets through what are entries."""
    rnd = random.Random(5)
    words = ["Ann", "Lee", "Ann Lee", "Acme", "Corp", "été", "x", ",", "Customer#1", "Customer#12"]
    segs = seg_df(spark, [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(60)])
    entries = spark.createDataFrame([("Ann Lee", "PERSON"), ("été", "ORG"), ("Customer#1", "PERSON"), ("Lee", "ORG"), ("Lee", "PERSON")], "entry string, label string")
    want = sorted(tuple(r) for r in D.detect_gazetteer(segs, entries).collect())
    assert want and sorted(tuple(r) for r in D.join_gazetteer(segs, entries).collect()) == want
    bits, lengths = D.dictionary_filter(D._prepared_dictionary(entries))
    assert len(bits) == D.FILTER_BITS // 8 and lengths == [3, 7, 10]
    assert D.EntryFilter(bits, lengths).stretches("x Ann Lee, Customer#12, été Corp " + "word " * 50) == [(2, "Ann Lee"), (6, "Lee"), (24, "été")]
    monkeypatch.setattr(D, "FILTER_BITS", 64)
    assert sorted(tuple(r) for r in D.join_gazetteer(segs, entries).collect()) == want


def test_row_guards_hold_wherever_a_rule_matches():
    """A guard may let a text pass for nothing, but never holds back one with a match; what the engines read differently has none."""
    rnd = random.Random(7)
    parts = ["a@b.co", "123-45-6789", "1.2.3.4", "4111111111111111", "DOB:", "born", "1/2/1990", "Jan 3, 1999", "+1 (212) 555-1234", "212-555", "1234",
             "\x0b", "\x1c", " ", "x12", "123456789", "1980", "12 Oak Street", "French", "4111 1111 1111 1111", "+1 212 555 0199", "2001-02-03", "_", "-", "."]
    texts = D.pa.array(["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8))) for _ in range(3000)])
    rules = [(p, ic) for _, p, ic in P.REGEX_PATTERNS] + [(r[1], False) for r in P.SCORED_RECOGNIZERS]
    for pattern, ignore_case in rules:
        guard = D.row_guard(pattern, ignore_case)
        exact = D.regex.compile(P.spaced_pattern(pattern), D.regex.I if ignore_case else 0).search
        assert guard and {k for k, t in enumerate(texts.to_pylist()) if exact(t)} <= {k for k, _ in D.Texts(texts).holding(guard)}
    assert [D.row_guard(p) for p in ("a$", "^a", "(a)\\1", "a++", "(?=a)a", "\\Za", "[^a]b", "a{2000}", "a{,2}b")] == [""] * 9


def test_rules_run_only_over_rows_that_their_guard_leaves(monkeypatch):
    """Before, each rule was tried on each text."""
    ran = []
    spaced = P.spaced_pattern

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, text):
            ran.append((self.pattern.pattern, text))
            return self.pattern.finditer(text)

    compiled = D.regex.compile
    rules = {spaced(r[1]) for r in P.SCORED_RECOGNIZERS}
    monkeypatch.setattr(D.regex, "compile", lambda p, *flags: Counting(compiled(p, *flags)) if p in rules else compiled(p, *flags))
    texts = D.Texts(D.pa.array(["Customer#000000001 of 1985", "ssn 123456789", None, "Customer 123456789"] * 50))
    D.scored_finder()()(texts)
    assert len(ran) == 50 and [s[0][:4] for s in texts.spans if s] == [(4, 13, "US_SSN", "123456789")] * 50


def test_dictionary_hits_of_a_batch_are_those_of_each_text(monkeypatch):
    """Texts are joined for their tokens, in blocks; nothing crosses from one text to the next, entries with line feeds included."""
    gazetteer = D.Gazetteer([("Ann\nLee", "PERSON", 10), ("Ann", "PERSON", 10), ("été", "ORG", 11), ("\U0001d518x y", "ORG", 11)])
    texts = ["Ann", "Lee", None, "", "Ann\nLee", "\U0001d518x y Annx été", "été"]
    want = [["Ann"], [], [], [], ["Ann", "Ann\nLee"], ["\U0001d518x y", "été"], ["été"]]
    for size in (1, 6, 1 << 20):
        monkeypatch.setattr(D, "JOIN_CHARACTERS", size)
        batch = D.Texts(D.pa.array(texts))
        gazetteer.find(batch)
        assert [[s[3] for s in found] for found in batch.spans] == want
        assert all(t[s[0]:s[1]] == s[3] for t, found in zip(texts, batch.spans) for s in found)


def test_texts_are_those_of_all_segments(spark):
    rows = [(1, " a\n\n\x1f\nb \n ", ["c", " ", None, "é"]), (2, None, ["x"]), (3, "", None), (4, " \né\r", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cells array<string>")
    want = sorted(tuple(r) for r in S.segment_all(docs).select("doc_id", "segment_index", "text").collect())
    assert sorted(tuple(r) for r in S.segment_texts(docs).collect()) == want and len(want) == 5
    plan = S.segment_texts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "cell_index" not in plan


def test_planted_text_keeps_within_what_the_jvm_compiles(spark):
    """Above 8,000 bytes of code a method is interpreted for good; the check digit alone took it there."""
    import contextlib
    import io
    import re

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (C.planted_documents, C.planted_truth):
            with contextlib.redirect_stdout(io.StringIO()) as shown:
                made(spark, SF).explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_check_digit(spark):
    rnd = random.Random(11)
    numbers = [4 * 10**14, 999999999999999, *(rnd.randrange(10**14, 10**15) for _ in range(300))]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.expr(luhn_check_digit_sql("n")).alias("d"))
    assert all(luhn_passes(f"{r.n}{r.d}") for r in df.collect())
    assert spark.sql(f"SELECT {luhn_check_digit_sql('cast(null as bigint)')} AS d").first().d is None


def test_prose_is_read_once_for_all_rules_of_a_layer(monkeypatch):
    """Before, every rule's guard read every row, and the words of a context every row that any guard had refused."""
    read = []

    def counting(name):
        exact = getattr(D.pc, name)
        monkeypatch.setattr(D.pc, name, lambda column, *args, **options: (read.append(len(column)), exact(column, *args, **options))[1])

    finders = [f() for f in (D.regex_finder(), D.scored_finder())]
    texts = ["so it goes"] * 998 + ["a@b.co, SSN 123456789, +1 212 555 0199", "123-45-6789 born 1980"]
    counting("match_substring_regex")
    counting("match_substring")
    for find, want in zip(finders, ([["EMAIL", "PHONE"], ["SSN"]], [["EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN"], ["DATE_TIME"]])):
        read.clear()
        batch = D.Texts(D.pa.array(texts))
        find(batch)
        assert [sorted(s[2] for s in found) for found in batch.spans[-2:]] == want and not any(batch.spans[:-2])
        assert sum(read) < 1100
    assert D.any_guard(["a", ""]) == D.any_guard([f"{c}{{999}}" for c in "abcdefgh" * 100]) == "" and D.any_guard(["(?i)a", "b"]) == "(?:(?i)a)|(?:b)"


def test_only_tokens_shaped_like_first_tokens_are_looked_up():
    asked = []
    gazetteer = D.Gazetteer([("Ann Lee", "PERSON", 10), ("été", "ORG", 11), ("w" * 80, "ORG", 11)])
    whole = "Ann and Bob saw Amy Lee, été, étude " + "w" * 80 + " " + "w" * 90
    starts, ends, _ = D.tokens_known(whole, lambda t: asked.append(t) or t in gazetteer.lengths, gazetteer.shapes)
    assert sorted(asked) == sorted(["Ann", "Amy", "été", "w" * 80, "w" * 90])
    assert [whole[a:b] for a, b in zip(starts, ends)] == ["Ann", "été", "w" * 80]
    assert [whole[a:b] for a, b in zip(*D.tokens_known(whole, gazetteer.lengths.__contains__)[:2])] == ["Ann", "été", "w" * 80]
    empty = D.Gazetteer([])
    empty.find(batch := D.Texts(D.pa.array(["Ann"])))
    assert batch.spans == [[]]
