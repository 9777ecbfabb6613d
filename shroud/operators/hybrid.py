"""The hybrid detector - layer union, span filters, resolution.

Order of work per segment (as in the reference): union of the layers ->
blocklist / short-name / numeric-date filters -> overlap resolution.  The
filters run before resolution, so a blocked long span never shadows a shorter
valid one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions import patterns as P
from shroud.functions.spans import empty_spans, kept_by_fold
from shroud.functions.text import digit_class, normalize_sql, q, strip_sql
from shroud.operators.detect import (
    Finder,
    Texts,
    dictionary_index,
    gazetteer_finder,
    join_gazetteer,
    regex_finder,
    scored_finder,
    span_rows,
    with_spans,
)
from shroud.operators.resolve import KINDS, resolve_segment_spans
from shroud.session import own_exchange, stored

BLOCKED = frozenset(P.IGNORED_ENTITIES)
LONGEST_BLOCKED = max(map(len, BLOCKED))  # no text gets shorter by lower()
ALL_LAYERS = ("regex", "gazetteer", "scored")


def layers_finder(layers: tuple[str, ...], gazetteer: Callable[[], Finder] | None = None, change: Callable[[Texts], None] | None = None) -> Callable[[], Finder]:
    """The layers over a batch of texts: regex, scored with mapped labels, and the gazetteer where its finder is given.  ``change`` is
    applied to what they found."""
    layer = {"gazetteer": gazetteer, "regex": regex_finder(), "scored": scored_finder(labels=P.SCORED_LABEL_MAP)}
    wanted = [layer[name] for name in ("gazetteer", "regex", "scored") if name in layers and layer[name]]

    def finder() -> Finder:
        finders = [f() for f in wanted]

        def find(texts: Texts) -> None:
            for f in finders:
                f(texts)
            if change:
                change(texts)

        return find

    return finder


def _finder(segments: DataFrame, layers: tuple[str, ...], index: list, change: Callable[[Texts], None] | None = None) -> Callable[[], Finder]:
    return layers_finder(layers, gazetteer_finder(segments.sparkSession, index) if "gazetteer" in layers else None, change)


def _index_of(dictionary: DataFrame | None, layers: tuple[str, ...]) -> list | None:
    """The dictionary's index where it is small enough for every worker; an empty one where the layer is not asked for."""
    return dictionary_index(dictionary) if "gazetteer" in layers and dictionary is not None else []


def candidate_spans(segments: DataFrame, dictionary: DataFrame | None = None,
                    layers: tuple[str, ...] = ALL_LAYERS) -> DataFrame:
    """Union of the layers as one relational span table (regex, gazetteer, scored).

    All layers of a segment are searched together in one pass, unless the dictionary is too large for the workers: then
    the gazetteer is a join and joins the union as a second branch.
    """
    return _candidates(segments, dictionary, layers, _index_of(dictionary, layers))


def _candidates(segments: DataFrame, dictionary: DataFrame | None, layers: tuple[str, ...], index: list | None) -> DataFrame:
    seg = segments.select("doc_id", "segment_index", "text")
    if index is not None:
        return span_rows(seg, _finder(seg, layers, index))
    found = join_gazetteer(seg, dictionary)
    row_local = tuple(l for l in layers if l != "gazetteer")
    return span_rows(seg, layers_finder(row_local)).unionByName(found) if row_local else found


def blocklist_sql(text: str) -> str:
    """True for spans whose normalised text is a blocklisted term."""
    return f"({normalize_sql(text)} IN (" + ", ".join(f"'{w}'" for w in P.IGNORED_ENTITIES) + "))"


def short_name_sql(etype: str, text: str) -> str:
    """PERSON / ORG / ADDRESS with at most two characters after stripping."""
    types = ", ".join(f"'{t}'" for t in P.SHORT_NAME_TYPES)
    return f"({etype} IN ({types}) AND length({strip_sql(text)}) <= 2)"


def numeric_dob_sql(etype: str, source: str, text: str) -> str:
    """A date of birth from a non-regex layer that is all digits (unstripped)."""
    return f"({etype} = 'DATE_OF_BIRTH' AND {source} <> 'regex' AND {text} rlike {q(f'(?U)\\A{digit_class()}+\\z')})"


def keep_sql(etype: str, source: str, text: str) -> str:
    """B6-B8 combined: True for spans that survive the filters."""
    return (f"NOT {blocklist_sql(text)} AND NOT {short_name_sql(etype, text)} "
            f"AND NOT {numeric_dob_sql(etype, source, text)}")


def keeps(texts: Texts) -> np.ndarray:
    """``keep_sql`` for what is found in a batch."""
    found = texts.found
    words = found.words.tolist()
    bare = {w: w.strip() for w in set(words)}  # values recur within a batch
    blocked = {w for w, b in bare.items() if len(b) <= LONGEST_BLOCKED and b.lower() in BLOCKED}
    short = {w for w, b in bare.items() if len(b) <= 2}
    removed = np.fromiter(map(blocked.__contains__, words), bool, len(words))
    if short:
        short_names = np.array([etype in P.SHORT_NAME_TYPES for etype, *_ in texts.kinds], bool)
        removed |= np.fromiter(map(short.__contains__, words), bool, len(words)) & short_names[found.kinds]
    dates = np.array([etype == "DATE_OF_BIRTH" and source != "regex" for etype, source, _ in texts.kinds], bool)
    some = np.flatnonzero(dates[found.kinds])
    removed[some] |= np.array([w.isdigit() for w in found.words[some].tolist()], bool)
    return ~removed


def resolve(texts: Texts) -> None:
    """Filters, then resolution, for the spans of each segment in a task."""
    kept = texts.found.at(keeps(texts))
    prios = np.array([prio for *_, prio in texts.kinds], np.int64)[kept.kinds]
    texts.found = kept.at(kept_by_fold(kept.rows, kept.starts, kept.ends, kept.scores, prios))


def filter_spans(spans: DataFrame) -> DataFrame:
    """B6-B8 as one row-local filter (the blocklist is a fixed list: an InSet lookup)."""
    return spans.where(F.expr(keep_sql("entity_type", "source", "text")))


def segment_spans(segments: DataFrame, dictionary: DataFrame | None = None, layers: tuple[str, ...] = ALL_LAYERS) -> DataFrame:
    """C11 with the text: ``segments`` and their resolved ``spans: array<span>``.  All of it happens in the segment's row; beyond
    the size of dictionary that a worker takes, spans are resolved on their own and join the segments (one shuffle of the text)."""
    index = _index_of(dictionary, layers)
    if index is not None:
        return with_spans(segments, _finder(segments, layers, index, resolve))
    spans = resolve_segment_spans(filter_spans(_candidates(segments, dictionary, layers, None)))
    span = F.struct(*[F.col(c).cast(k).alias(c) for c, k in KINDS.items()])
    grouped = spans.groupBy("doc_id", "segment_index").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # of one segment
    return segments.join(grouped, ["doc_id", "segment_index"], "left").withColumn("spans", F.coalesce("spans", empty_spans()))


def hybrid_spans(segments: DataFrame, dictionary: DataFrame | None = None,
                 layers: tuple[str, ...] = ALL_LAYERS) -> DataFrame:
    """C11: resolved, non-overlapping spans per segment.  No shuffle; beyond the size of dictionary that a worker takes, one
    shuffle of spans (not of text)."""
    seg, index = segments.select("doc_id", "segment_index", "text"), _index_of(dictionary, layers)
    if index is None:
        return resolve_segment_spans(filter_spans(_candidates(seg, dictionary, layers, None)))
    return span_rows(seg, _finder(seg, layers, index, resolve))


def predicted(spans: str = "spans") -> Column:
    """``predictions`` for an array of spans: texts stripped, empty ones dropped."""
    return F.expr(f"filter(transform({spans}, ps -> named_struct('start', ps.start, 'end', ps.`end`, 'entity_type', ps.entity_type, "
                  f"'text', {strip_sql('ps.text')})), pf -> length(pf.text) > 0)")


def predictions(resolved: DataFrame) -> DataFrame:
    """The prediction records - text stripped, empty ones dropped,
    offsets left as detected."""
    return (
        resolved.withColumn("text", F.expr(strip_sql("text")))
        .where(F.length("text") > 0)
        .select("doc_id", "segment_index", "start", "end", "entity_type", "text", "score", "source")
    )


def detect_distinct(segments: DataFrame, detector) -> DataFrame:
    """Run a row-local detector once per distinct text; every segment gets the spans of its text.

    A text is named by 128 bits of two hashes.  Hashes are counted first (partial counts before the shuffle); only hashes
    found twice or more meet the segments, in a join where both sides have an exchange of their own, so that AQE can split
    the rows of a hot text.  The first row of a repeated text and every other text keep their text, the detector runs once
    over that, and its spans are stored; the other rows of a repeated text then get them by hash, without texts.
    """
    names = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.reverse("text")).alias("_h2")]
    named = segments.select("doc_id", "segment_index", "text", *names)
    row = F.struct("doc_id", "segment_index")
    repeated = named.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first")).where("_n > 1").drop("_n")
    flagged = named.join(own_exchange(repeated, "_h1", "_h2"), ["_h1", "_h2"], "left")
    owns = F.coalesce(F.col("_first") == row, F.lit(True))
    once = flagged.withColumns({"text": F.when(owns, F.col("text")).otherwise(""), "_owns": owns})
    found = stored(detector(once).select("doc_id", "segment_index", "_h1", "_h2", "_owns", F.col("_first").isNotNull().alias("_shared"), "spans"))
    own = found.where(F.col("_owns") & (F.size("spans") > 0))
    given = own.where("_shared").select("_h1", "_h2", "spans")
    others = found.where(~F.col("_owns")).select("doc_id", "segment_index", "_h1", "_h2").join(given, ["_h1", "_h2"])
    return own.select("doc_id", "segment_index", "spans").unionByName(others.select("doc_id", "segment_index", "spans"))
