"""Columns over hash texts: one canonical spelling, 64-bit halves, Hamming distance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything that leaves no ink: blanks of all kinds and zero-width characters.
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
#: Prefixes that name the hash or the base, in any order, with their separators.
PREFIX = r"(?:sha-?2?-?256|[a-z]?hash|hex|base-?16|0x|[:=_#/-])*"


def usable_hex(text: Column, digits: int) -> Column:
    """The lower-case digits of a hash text, or null unless it holds exactly ``digits`` of them.

    Blanks, letter case and a prefix that names the hash or the base don't count.
    """
    bare = F.lower(F.regexp_replace(text, BLANKS, ""))
    found = F.regexp_extract(bare, f"^{PREFIX}([0-9a-f]{{{digits}}})$", 1)
    return F.when(found != "", found)


def usable_sql(column: str, digits: int) -> str:
    """The same rule in the SQL that queries are compared with."""
    blanks = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", BLANKS)
    return f"nullif(regexp_extract(lower(regexp_replace({column}, '{blanks}', '', 'g')), '^{PREFIX}([0-9a-f]{{{digits}}})$', 1), '')"


def hex64(digits: Column) -> Column:
    """16 hex digits as a signed 64-bit value with the same bits."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_halves(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Distance of two fingerprints kept as unsigned 32-bit halves."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))
