"""Scalar text expressions: strip / normalise / digits / Luhn / regex matches with offsets.

Every builder returns Spark SQL expression *text* (``*_sql``) so that a whole
expression tree crosses from Python to the JVM in one call (``F.expr``); the
thin Column wrappers are for top-level use.  All of it runs inside the JVM.
Offsets are 0-based and half-open, counted in code points, the same unit as
Spark's ``length`` / ``substring``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions.patterns import NOT_SPACE_CLASS, SPACE_CLASS

# Elements that a fold appends to one array before it starts another: appending copies the array, so a fold over n
# elements costs n * BLOCK instead of n * n.
BLOCK = 128

LOCATED_TYPE = "array<struct<start:int,end:int,text:string>>"


def values_of(column: pa.Array) -> list:
    """``column.to_pylist()`` by way of numpy where that holds the values as they are: about ten times as fast for strings and integers."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def q(pattern: str) -> str:
    """A raw SQL string literal (no escape processing); patterns hold no quote."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def shows_sql(c: str) -> str:
    """True if ``c`` begins with a printable ASCII character, no space: what most texts do, told without a pattern."""
    return f"ascii({c}) BETWEEN 33 AND 126"


def strip_sql(c: str) -> str:
    """Remove leading and trailing white space, as Python's ``str.strip`` sees it."""
    pattern = f"(?U)\\A{SPACE_CLASS}+|{SPACE_CLASS}+\\z"
    return f"(CASE WHEN {shows_sql(c)} AND {shows_sql(f'right({c}, 1)')} THEN {c} ELSE regexp_replace({c}, {q(pattern)}, '') END)"


def normalize_sql(c: str) -> str:
    """strip, then lower case: the matching and consistency key of a value."""
    return f"lower({strip_sql(c)})"


def non_blank_sql(c: str) -> str:
    return f"({shows_sql(c)} OR {c} rlike {q('(?U)' + NOT_SPACE_CLASS)})"


@lru_cache
def decimal_digits() -> str:
    """All decimal digits of Unicode, zero to nine of each script in turn."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")


@lru_cache
def digit_class() -> str:
    """Class of what ``str.isdigit`` takes: decimal digits, and digits such as superscripts."""
    others = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return r"[\d" + "".join(f"\\x{{{c:x}}}" for c in others) + "]"


def digits_only_sql(c: str) -> str:
    """The decimal digits of any script, as 0-9."""
    digits = decimal_digits()
    values = "".join(str(unicodedata.digit(d)) for d in digits)
    return f"translate(regexp_replace({c}, {q(r'(?U)[^\d]')}, ''), '{digits}', '{values}')"


def luhn_ok_sql(d: str, v: str = "lh") -> str:
    """Luhn check over a digit string; fewer than 13 digits is never valid.

    From the right, every second digit is doubled (minus 9 above 9); the sum
    must be divisible by 10.  ``v`` names the lambda variables (unique per nesting).
    """
    dig = f"try_cast(substring({d}, length({d}) - {v}i, 1) as int)"
    body = f"CASE WHEN {v}i % 2 = 1 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) ELSE {dig} END"
    total = f"aggregate(sequence(0, length({d}) - 1), 0, ({v}a, {v}i) -> {v}a + {body})"
    return f"(CASE WHEN length({d}) >= 13 THEN coalesce({total} % 10 = 0, false) ELSE false END)"


def luhn_passes(text: str) -> bool:
    """``luhn_ok_sql`` over the digits of ``text``, in a task."""
    values = [int(c) for c in text if c.isdecimal()][::-1]
    return len(values) >= 13 and (sum(values[::2]) + sum(2 * v - 9 if v > 4 else 2 * v for v in values[1::2])) % 10 == 0


def luhn_passing(texts: Sequence[str]) -> np.ndarray:
    """``luhn_passes`` for each text; those that are ASCII digits only, and as long, together."""
    passing, plain = np.zeros(len(texts), bool), defaultdict(list)
    for k, text in enumerate(texts):
        if text.isascii() and text.isdigit():
            plain[len(text)].append(k)
        else:
            passing[k] = luhn_passes(text)
    for n, places in plain.items():
        values = np.frombuffer("".join([texts[k] for k in places]).encode(), np.uint8).reshape(-1, n)[:, ::-1].astype(np.int64) - 48
        doubled = 2 * values[:, 1::2]
        total = values[:, ::2].sum(axis=1) + (doubled - 9 * (doubled > 9)).sum(axis=1)
        passing[places] = (n >= 13) & (total % 10 == 0)
    return passing


def luhn_check_digit_sql(n: str, digits: int = 15) -> str:
    """Digit that makes the number ``n`` (bigint, at most ``digits`` digits), followed by it, pass the Luhn check."""
    pairs = [p // 10 + p % 10 * 2 - (9 if p % 10 > 4 else 0) for p in range(100)]  # what two neighbouring digits add, the right one doubled
    terms = [f"get(array({', '.join(map(str, pairs))}), cast({n} div {100 ** j} % 100 as int))" for j in range((digits + 1) // 2)]
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 as int)"


def guard_sql(text: str, guard: tuple[str, str] | None) -> str | None:
    if guard is None:
        return None
    kind, arg = guard
    if kind == "contains":
        return f"(instr({text}, '{arg}') > 0)"
    return f"({text} rlike {q('(?U)' + arg)})"


def regex_matches_sql(text: str, jpattern: str, guard: str | None = None) -> str:
    """All non-overlapping, leftmost-first matches of a Java pattern (array<string>).

    ``guard`` is a necessary condition for any match; rows failing it skip the
    pattern entirely.
    """
    m = f"regexp_extract_all({text}, {q(jpattern)}, 0)"
    if guard is not None:
        m = f"CASE WHEN {guard} THEN {m} ELSE cast(array() as array<string>) END"
    return m


def blocked_sql(array: str, v: str) -> str:
    """The array as an array of blocks of at most BLOCK elements.  The array expression is bound once, as the only
    element of another array."""
    return (f"flatten(transform(array({array}), {v}w -> transform(sequence(0, greatest(size({v}w) - 1, 0) div {BLOCK}), "
            f"{v}b -> slice({v}w, {v}b * {BLOCK} + 1, {BLOCK}))))")


def running_sum_sql(lengths: str, v: str) -> str:
    """Inclusive running sums of an array of ints, in blocks: sums inside each block, then what came before it."""
    inner = (f"aggregate({v}k, named_struct('t', 0, 'o', cast(array() as array<int>)), "
             f"({v}a, {v}x) -> named_struct('t', {v}a.t + {v}x, 'o', concat({v}a.o, array({v}a.t + {v}x))))")
    sums = f"transform({blocked_sql(lengths, v)}, {v}k -> {inner})"
    # the totals of all blocks before each block, by the same fold over far fewer elements
    outer = (f"aggregate({sums}, named_struct('t', 0, 'o', cast(array() as array<array<int>>)), ({v}c, {v}y) -> named_struct("
             f"'t', {v}c.t + {v}y.t, 'o', concat({v}c.o, array(transform({v}y.o, {v}z -> {v}z + {v}c.t)))), {v}c -> {v}c.o)")
    return f"flatten({outer})"


def locate_matches_sql(text: str, matches: str, jpattern: str, v: str = "lm") -> str:
    """Attach offsets to the matches of ``jpattern`` in ``text``.

    ``split(text, p, -1)`` yields the gaps between the same matches, so the i-th match ends at the running sum of
    gaps and matches up to it.  ``split`` only runs where a match exists.  Never ``locate(match)``: the first
    occurrence of the matched text need not be the match itself.
    """
    n = f"size({matches})"
    lengths = (f"zip_with(slice(split({text}, {q(jpattern)}, -1), 1, {n}), {matches}, "
               f"({v}g, {v}m) -> length({v}g) + length({v}m))")
    ends = running_sum_sql(f"{lengths}", v)
    located = (f"zip_with({ends}, {matches}, ({v}e, {v}t) -> named_struct('start', {v}e - length({v}t), 'end', {v}e, 'text', {v}t))")
    return f"(CASE WHEN {n} > 0 THEN {located} ELSE cast(array() as {LOCATED_TYPE}) END)"


# Column wrappers -------------------------------------------------------------------

def strip(c: str) -> Column:
    return F.expr(strip_sql(c))


def normalize(c: str) -> Column:
    return F.expr(normalize_sql(c))


def non_blank(c: str) -> Column:
    return F.expr(non_blank_sql(c))


def digits_only(c: str) -> Column:
    return F.expr(digits_only_sql(c))


def luhn_ok(d: str) -> Column:
    return F.expr(luhn_ok_sql(d))
