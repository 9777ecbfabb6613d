"""Operator 13: toxicity by a weighted finite-state grammar over clauses.

Three layers of transducers, composed:

* letters to classes: a word is read letter by letter to its longest known stem, which gives its class (insult, threat,
  target, negation, reported speech) and a weight.  Insults are learned: stems and whole words that labelled documents
  show to go with label 1, weighted by shrunken log odds along the chain of their stems, so that a harmless word
  with a bad stem gets its own weight.  The other classes are short fixed lists;
* classes to marked classes: small machines, one each for target, threat, negation and reported speech, copy the classes of a
  clause and mark an insult or threat that is aimed at somebody, denied, or told by another.  Their product is one
  deterministic table;
* marked classes to a score: of each kind of match the strongest in a clause counts; clauses add up by their fourth powers,
  so that many weak ones in a long text do not make a strong one; and a logistic layer weighs the kinds, none below zero.  What is aimed counts as a match and once more as aimed.

Fitting uses labelled documents outside the held-out fifth, at most about ``FIT_DOCS`` of them chosen by a hash of the id; of
near copies (one least shingle hash) one.  The logistic layer sees every document through a lexicon that was learned without
the document's own fold.  The label, and nothing else but the text, enters: not language, source or id.  Scoring is
row-local over whole texts.

Defined results: null or empty texts match nothing and get the score of no match.  A null id is not held out.  Several
labels of one id count as the highest; labels without id or value are passed over.  Without usable labels the fixed lists
and starting weights score.  Repeated rows are scored each by itself; an empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import stored

FOLDS = 5  # remainder 0 is held out
FIT_DOCS = 16_384  # about so many labelled documents are learned from
ENTRIES = 8_192  # bound of the learned stems and words, and of their harmless relatives
STEM, LONGEST = 3, 9  # letters of a stem
SHINGLE = 4  # words; near copies are told by their least shingle hash
SEEN, SURE, LIFT = 3, 2.0, math.log(3)  # toxic documents with an entry, and its log odds ratio less SURE standard errors
RELATIVE_SEEN = 4  # documents with a word under a learned stem that give it a weight of its own
SHRINK = 2.0  # documents that the stem's share counts for in a longer entry's
LEAST_WEIGHT = 1.0  # weaker words are no insults
COUNTED_AT_ONCE = 400_000
CACHE = 500_000  # words a worker remembers

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
SYMBOLS = range(8)
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;|\n]+|[\"“”„«»]")

# Starting lists in four languages, whole words in lower case.
INSULTS = """idiot moron loser scum trash stupid worthless pathetic disgusting clown imbecile fool dumb
idiotin dummkopf trottel abschaum dumm wertlos idiote imbécile stupide minable ordure idiota imbécil estúpido basura inútil""".split()
THREATS = """kill hurt murder destroy shoot stab burn beat töten umbringen verletzen schlagen erschießen
tuer frapper détruire brûler blesser matar golpear destruir quemar herir""".split()
TARGETS = """you your you're u he she they him her them these those du dich dir dein ihr euch er ihn ihm
tu te toi vous ton il elle ils elles lui tú ti usted ustedes él ella ellos""".split()
NEGATIONS = """not no never don't doesn't isn't aren't wasn't won't without nicht kein keine nie niemals
pas jamais aucun aucune sans nunca jamás ningún ninguna sin""".split()
REPORTS = """said says say claimed called wrote quoted told alleged sagte sagt behauptete nannte schrieb
dit disait affirmait écrit appelé dijo dice afirmó llamó escribió""".split()
CLASSES = {INSULT: INSULTS, THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
LISTED_SHARE = 0.9  # of documents with a listed insult or threat that are expected to be toxic

# kinds of matches, the logistic layer's starting weight for each, and for no match at all
PLAIN, AIMED, THREATENING, AIMED_THREAT, MUTED = range(5)
START = np.array([0.6, 0.2, 0.3, 0.4, 0.1, -3.0])
RIDGE = 0.5
POWER = 4  # by which clauses add up


class Transducer:
    """A deterministic machine over ``SYMBOLS`` that copies what it reads and may add a mark to it."""

    def __init__(self, start: object, step) -> None:
        """``step(state, symbol) -> (state, mark or "")``; states are whatever it returns."""
        self.start, self.step = start, step

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: since marks do not hide the symbol, the other machine reads the same symbols."""

        def step(state, symbol):
            (one, mark), (two, more) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (one, two), mark + more

        return Transducer((self.start, other.start), step)

    def table(self, kind_of) -> list[list[tuple[int, int]]]:
        """Rows of (next state, kind of match or -1) per symbol, for the states that can be reached."""
        number, queue, rows = {self.start: 0}, [self.start], []
        for state in queue:
            row = []
            for symbol in SYMBOLS:
                then, marks = self.step(state, symbol)
                if then not in number:
                    number[then] = len(number)
                    queue.append(then)
                row.append((number[then], kind_of(symbol, marks)))
            rows.append(row)
        return rows


def window(opens: set[int], marked: set[int], width: int, mark: str) -> Transducer:
    """Marks ``marked`` symbols among the ``width`` that follow one of ``opens`` in the clause."""

    def step(state: int, symbol: int) -> tuple[int, str]:
        then = 0 if symbol == END else width if symbol in opens else max(0, state - 1)
        return then, mark if state and symbol in marked else ""

    return Transducer(0, step)


def speech() -> Transducer:
    """Marks insults and threats in quotation marks, or after a word of saying up to the clause's end."""

    def step(state: str, symbol: int) -> tuple[str, str]:
        if symbol == END:
            return "own", ""
        if symbol == REPORT:
            return "told", ""
        if symbol == QUOTE:
            return {"own": "quoted", "quoted": "own", "told": "told"}[state], ""
        return state, "r" if state != "own" and symbol in (INSULT, THREAT) else ""

    return Transducer("own", step)


def kind_of(symbol: int, marks: str) -> int:
    """t: after a target; l: a target after an insult; k: a target after a threat; n: denied; r: told."""
    if symbol == TARGET:
        return AIMED_THREAT if "k" in marks else AIMED if "l" in marks else -1
    if symbol not in (INSULT, THREAT):
        return -1
    if "n" in marks or "r" in marks:
        return MUTED
    if symbol == THREAT:
        return AIMED_THREAT if "t" in marks else THREATENING
    return AIMED if "t" in marks else PLAIN


def grammar() -> list[list[tuple[int, int]]]:
    bad = {INSULT, THREAT}
    aimed = window({TARGET}, bad, 6, "t") * window({INSULT}, {TARGET}, 3, "l") * window({THREAT}, {TARGET}, 3, "k")
    return (aimed * window({NEGATION}, bad, 3, "n") * speech()).table(kind_of)


GRAMMAR = grammar()


@dataclass
class Lexicon:
    """Stems and whole words (ending in "$") with weights; the longest that a word begins with, or is, decides."""

    weights: dict[str, float]
    cache: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fixed = {w: c for c in (TARGET, NEGATION, REPORT) for w in CLASSES[c]}
        self.threats = set(THREATS)

    def read(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[word] = self.classify(word)
        return found

    def classify(self, word: str) -> tuple[int, float]:
        if not word[0].isalnum():
            return (QUOTE if word in "\"“”„«»" else END), 0.0
        weight = self.weights.get(word + "$")
        if weight is None:
            for n in range(min(LONGEST, len(word) - 1), STEM - 1, -1):
                weight = self.weights.get(word[:n])
                if weight is not None:
                    break
        if weight is not None and weight >= LEAST_WEIGHT:
            return (THREAT if word in self.threats else INSULT), weight
        return self.fixed.get(word, OTHER), 0.0

    def matches(self, text: str) -> list[float]:
        """Per kind of match: the strongest of each clause, added up by ``POWER``."""
        read = [self.read(t) for t in TOKEN.findall(text.lower())]
        total = [0.0] * 5
        if not any(w for _, w in read):
            return total
        state, last, clause = 0, 0.0, [0.0] * 5
        for symbol, weight in [*read, (END, 0.0)]:
            state, kind = GRAMMAR[state][symbol]
            last = weight or last
            if kind >= 0:
                clause[kind] = max(clause[kind], last)
                if kind in (AIMED, AIMED_THREAT):
                    clause[kind - 1] = max(clause[kind - 1], last)
            elif symbol == END:
                if any(clause):
                    total = [a + b ** POWER for a, b in zip(total, clause)]
                    clause = [0.0] * 5
                last = 0.0
        return [a ** (1 / POWER) for a in total]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray  # of the kinds, then of no match

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = np.array([self.lexicon.matches(t or "") for t in texts]).reshape(-1, 5)
        return logistic(found @ self.coefficients[:-1] + self.coefficients[-1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def entries(text: str) -> set[str]:
    """Distinct stems and whole words of a text."""
    out = set()
    for word in {t for t in TOKEN.findall(text.lower()) if t[0].isalnum()}:
        out.add(word + "$")
        out.update(word[:n] for n in range(STEM, min(LONGEST, len(word) - 1) + 1))
    return out


def sketch(text: str) -> int:
    """The least shingle hash: near copies share it in most cases, other documents do not."""
    words = text.lower().encode().split()
    shingles = (b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    return min(xxhash.xxh64_intdigest(s) for s in shingles) - (1 << 63)


def log_odds_bound(a: Column, b: Column, toxic: int, clean: int) -> Column:
    ratio = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    return ratio - SURE * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def weigh(counts: dict[str, tuple[int, int]], share: float) -> dict[str, float]:
    """Log odds against the overall ``share`` of toxic documents, of (toxic, clean) documents per entry; each entry is shrunk
    towards its longest shorter stem, a listed insult or threat towards ``LISTED_SHARE``."""
    shares: dict[str, float] = {}
    listed = {w + "$" for w in (*INSULTS, *THREATS)}
    for entry in sorted({*counts, *listed}, key=lambda e: (len(e.rstrip("$")), e.endswith("$"), e)):
        stem = entry.rstrip("$")
        near = next((shares[stem[:n]] for n in range(min(LONGEST, len(stem) - (not entry.endswith("$"))), STEM - 1, -1) if stem[:n] in shares), share)
        a, b = counts.get(entry, (0, 0))
        shares[entry] = (a + SHRINK * (LISTED_SHARE if entry in listed else min(near, LISTED_SHARE))) / (a + b + SHRINK)
    return {e: math.log(s / (1 - s)) - math.log(share / (1 - share)) for e, s in shares.items()}


def regression(found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression on the match sums, drawn to the starting weights; Newton's method, kinds held at zero or above."""
    x = np.column_stack([found, np.ones(len(found))])
    w = START.copy()
    for _ in range(50):
        p = logistic(x @ w)
        gradient = x.T @ (p - toxic) + RIDGE * (w - START)
        free = (w > 0) | (gradient < 0)
        free[-1] = True
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        then = w - move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        then[:-1] = np.maximum(0, then[:-1])
        done = np.abs(then - w).max() < 1e-9
        w = then
        if done:
            break
    return w


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fold) -> (entry, documents by label and fold), added up per task."""
    seen: Counter[tuple[str, int]] = Counter()

    def out() -> pa.RecordBatch:
        rows: dict[str, list[int]] = {}
        for (entry, place), n in seen.items():
            rows.setdefault(entry, [0] * 2 * FOLDS)[place] = n
        columns = np.array(list(rows.values()), np.int64).reshape(-1, 2 * FOLDS)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), *(pa.array(c) for c in columns.T)], ["entry", *PLACES])

    for batch in batches:
        for text, toxic, place in zip(*(batch.column(k).to_pylist() for k in range(3))):
            seen.update((e, toxic * FOLDS + place) for e in entries(text or ""))
            if len(seen) > COUNTED_AT_ONCE:
                yield out()
                seen.clear()
    yield out()


PLACES = [f"n{k}" for k in range(2 * FOLDS)]


def sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, fold) of about ``FIT_DOCS`` labelled documents outside the held-out fold, one of near copies."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    kept = FIT_DOCS / max(FIT_DOCS, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < kept * (1 << 20)).withColumn("fold", fold("doc_id").cast("int"))
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"))  # broadcast: about FIT_DOCS rows of three numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketch(t) for t in batch.column(0).to_pylist()], pa.int64())], [*batch.schema.names, "sketch"])

    one = both.mapInArrow(run, "text string, toxic int, fold int, sketch long").groupBy("sketch", "toxic").agg(F.min_by(F.struct("text", "fold"), "fold").alias("one"))
    return stored(one.select("one.text", "toxic", "one.fold"))


def learned_entries(rows: DataFrame, toxic: int, clean: int) -> dict[str, list[int]]:
    """Documents by label and fold, of entries that go with the label and of the words under learned stems."""
    counts = rows.select("text", "toxic", "fold").mapInArrow(_counted, "entry string, " + ", ".join(f"{p} long" for p in PLACES))
    a, b = (sum((F.col(p) for p in PLACES[k * FOLDS + 1:(k + 1) * FOLDS]), F.lit(0)) for k in (1, 0))
    counts = counts.groupBy("entry").agg(*(F.sum(p).alias(p) for p in PLACES)).withColumn("a", a).withColumn("b", b)
    counts = stored(counts.where(F.col("a") + F.col("b") >= SEEN))
    bound = log_odds_bound(F.col("a"), F.col("b"), toxic, clean)
    listed = F.col("entry").isin([w + "$" for w in (*INSULTS, *THREATS)])
    found = counts.where((F.col("a") >= SEEN) & (bound > LIFT) | listed).orderBy(listed.desc(), bound.desc(), "entry").limit(ENTRIES).collect()
    stems = {r["entry"] for r in found if not r["entry"].endswith("$")}

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(e[:n] in stems for n in range(STEM, min(LONGEST, len(e)) + 1)) for e in batch.column(0).to_pylist()], pa.bool_()))

    relatives = counts.where(F.col("a") + F.col("b") >= RELATIVE_SEEN).mapInArrow(under, counts.schema)
    more = relatives.orderBy(F.col("b").desc(), "entry").limit(ENTRIES).collect()
    return {r["entry"]: [r[p] for p in PLACES] for r in (*found, *more)}


def lexicon(found: dict[str, list[int]], share: float, without: int = 0) -> Lexicon:
    """Weights from all folds but ``without``."""
    folds = [k for k in range(1, FOLDS) if k != without]
    return Lexicon(weigh({e: (sum(n[FOLDS + k] for k in folds), sum(n[k] for k in folds)) for e, n in found.items()}, share))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = sample(df, labels, id_col, text_col)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(lexicon({}, 0.1), START)
    share = toxic / (toxic + clean)
    found = learned_entries(rows, toxic, clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = {k: lexicon(found, share, k) for k in range(1, FOLDS)}
        for batch in batches:
            hits = [others[k].matches(t) for t, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            columns = np.array(hits).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), batch.column(1)], [*(f"f{k}" for k in range(5)), "toxic"])

    seen = np.array([tuple(r) for r in rows.select("text", "toxic", "fold").mapInArrow(
        run, ", ".join(f"f{k} double" for k in range(5)) + ", toxic int").collect()])  # about FIT_DOCS rows of six numbers
    seen = seen[np.lexsort(seen.T)]
    return Model(lexicon(found, share), regression(seen[:, :5], seen[:, 5]))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = fit(df, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(rows.column(1).to_pylist()))], [id_col, "score"])

    kind = dict(df.dtypes)[id_col]
    scored = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
