"""Ids that are decimal numbers in more than one spelling."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _digit_map() -> tuple[str, str]:
    """All Unicode decimal digits outside ASCII, and the ASCII digit of each (from the character database)."""
    src = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(src), "".join(str(unicodedata.decimal(c)) for c in src)


@lru_cache(maxsize=1)
def _blank_chars() -> str:
    """Every character that Python's str.strip removes."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def canonical_id(c: Column | str) -> Column:
    """The digits of the number that c spells, without leading zeros; null if it spells none.

    White space around the number, leading zeros, a fraction of zero and digits
    of other scripts do not matter. Null, blank and damaged values give null.
    The result is a string, so no number is too large.
    """
    c = F.col(c) if isinstance(c, str) else c
    src, dst = _digit_map()
    plain = c.rlike(r"^[1-9][0-9]*\z")  # $ would also match before a final line feed
    t = F.translate(F.btrim(c, F.lit(_blank_chars())), src, dst)
    number = F.when(t.rlike(r"^[0-9]+(\.0*)?\z"), F.regexp_replace(F.regexp_replace(t, r"\.0*$", ""), r"^0+(?=[0-9])", ""))
    return F.when(plain, c).otherwise(number)


def is_blank(c: Column | str) -> Column:
    """True for null and for values of white space only."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.btrim(c, F.lit(_blank_chars())) == "")
