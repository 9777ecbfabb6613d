"""Deterministic synthetic values.

The consistency cache of a sequential tool becomes a pure function: the
surrogate of a value is derived from ``md5(salt :: TYPE :: lower(strip(value)))``.
Same key -> same surrogate on every executor, in any order, with no state and
no shuffle.  Document scope puts the doc_id into the salt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions import patterns as P
from shroud.functions.text import luhn_check_digit_sql, normalize_sql


def consistency_key_sql(etype: str, original: str) -> str:
    """TYPE::lower(strip(original))."""
    return f"concat_ws('::', {etype}, {normalize_sql(original)})"


def consistency_key(etype: str, original: str) -> Column:
    return F.expr(consistency_key_sql(etype, original))


def salt_sql(scope: str = "corpus", doc_id: str = "doc_id", salt: str = P.SURROGATE_SALT) -> str:
    """Corpus scope -> one salt; document scope -> salt::doc_id."""
    if scope == "document":
        return f"concat('{salt}', '::', cast({doc_id} as string))"
    return f"'{salt}'"


def _pool(pool: list[str]) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in pool) + ")"


def _pick(pool: list[str], h: str) -> str:
    return f"element_at({_pool(pool)}, cast({h} % {len(pool)} + 1 as int))"


def _lp(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


def surrogate_sql(etype: str, original: str, salt: str | None = None, as_of: str = P.SURROGATE_AS_OF) -> str:
    """The synthetic value for (type, original).

    h0..h3 are the four 8-hex-digit groups of the md5 as unsigned 32-bit numbers.  The md5 is bound once, as the only element
    of an array.
    """
    salt = salt or f"'{P.SURROGATE_SALT}'"
    md = f"md5(concat({salt}, '::', {consistency_key_sql(etype, original)}))"
    h = [f"cast(conv(substring(smd, {8 * i + 1}, 8), 16, 10) as bigint)" for i in range(4)]
    first, last = _pick(P.FIRST_NAMES, h[0]), _pick(P.LAST_NAMES, h[1])
    payload = f"concat('4', {_lp(f'{h[0]} % 10000000', 7)}, {_lp(f'{h[1]} % 10000000', 7)})"
    card = f"element_at(transform(array(cast({payload} as bigint)), scn -> concat(cast(scn as string), cast({luhn_check_digit_sql('scn')} as string))), 1)"
    return f"""element_at(transform(array({md}), smd -> CASE
  WHEN {etype} = 'PERSON' THEN concat({first}, ' ', {last})
  WHEN {etype} = 'EMAIL' THEN concat(lower({first}), '.', lower({last}), cast({h[2]} % 100 as string), '@', {_pick(P.EMAIL_DOMAINS, h[3])})
  WHEN {etype} = 'PHONE' THEN concat('(', cast(200 + {h[0]} % 800 as string), ') 555-', {_lp(f'{h[1]} % 10000', 4)})
  WHEN {etype} = 'ORG' THEN concat({_pick(P.COMPANY_WORDS, h[0])}, ' ', {_pick(P.COMPANY_SUFFIXES, h[1])})
  WHEN {etype} = 'ADDRESS' THEN {_pick(P.CITIES, h[0])}
  WHEN {etype} = 'SSN' THEN concat({_lp(f'1 + {h[0]} % 665', 3)}, '-', {_lp(f'1 + {h[1]} % 99', 2)}, '-', {_lp(f'1 + {h[2]} % 9999', 4)})
  WHEN {etype} = 'CREDIT_CARD' THEN {card}
  WHEN {etype} = 'DATE_OF_BIRTH' THEN date_format(date_sub(DATE'{as_of}', cast(6575 + {h[0]} % 22645 as int)), 'MM/dd/yyyy')
  WHEN {etype} = 'IP_ADDRESS' THEN concat('10.', cast({h[0]} % 256 as string), '.', cast({h[1]} % 256 as string), '.', cast(1 + {h[2]} % 254 as string))
  ELSE concat('[REDACTED_', {etype}, ']') END), 1)"""


def surrogate(etype: str, original: str, salt: str | None = None) -> Column:
    return F.expr(surrogate_sql(etype, original, salt))
