"""Comparison keys for place names, codes and identifiers.

Unicode decomposition is the only step Spark lacks, so it is the only one outside the JVM: Arrow's
own function on whole Arrow batches. The rest are built-in expressions.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import present

# Code placeholders in boundary data that stand for "none".
NO_CODE = "-99"
NO_COUNTRY = ("-99", "-1")
ID_PREFIX = "non-un:"


# Fixed value: the white space that trimming removes.
WHITE_SPACE = ("\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")


@F.arrow_udf(T.StringType())
def _nfd(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFD")


@F.arrow_udf(T.StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKD")


def trim_space(text: Column) -> Column:
    """Strip all leading and trailing white space (``F.trim`` alone strips blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def name_key(text: Column) -> Column:
    """Key for comparing names: case, accents on Latin letters and punctuation do not count.

    Spaces, standalone letters such as ``ß`` and marks on non-Latin letters are kept. One pass drops
    marks right after a Latin letter and punctuation; a mark after punctuation stays.
    """
    return F.regexp_replace(F.lower(_nfd(trim_space(text))), r"(\p{IsLatin})\p{M}+|\p{P}", "$1")


def label_key(text: Column) -> Column:
    """Key for comparing labels: only ``a-z0-9`` survive; null stays null."""
    lowered = F.lower(F.regexp_replace(_nfkd(text), r"[\x{0300}-\x{036F}]", ""))
    return F.regexp_replace(lowered, r"[^a-z0-9]+", "")


def slug_id(text: Column, prefix: str = ID_PREFIX) -> Column:
    """Identifier from a name; a combining mark breaks the word (``Curaçao`` gives ``curac-ao``)."""
    dashed = F.regexp_replace(_nfkd(text), r"[^a-zA-Z0-9]+", "-")
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(dashed, r"^-|-$", "")))


def code_keys(*codes: Column) -> Column:
    """The usable codes of a feature as one array without repeats."""
    return F.array_distinct(present(*codes, drop=("", NO_CODE)))


def feature_id(prefix: Column, source: Column | None, *ids: Column) -> Column:
    """``prefix[:source]:id`` from the first id that is present."""
    parts = [prefix] + ([source] if source is not None else [])
    return F.concat_ws(":", *parts, F.coalesce(*[i.cast("string") for i in ids]))


def split_labels(*labels: Column) -> Column:
    """Every label of the given columns, splitting multi-valued ones at ``|`` and ``;``."""
    given = present(*labels)
    return F.filter(F.flatten(F.transform(given, lambda v: F.split(v, "[|;]"))), lambda v: v != "")


def country_code(code: Column) -> Column:
    """Country part of a subdivision code (``US-MI`` gives ``US``)."""
    return F.upper(F.substring_index(code, "-", 1))


def country_codes(codes: Column) -> Column:
    """Known country parts of an array of codes.

    A code that starts with a dash has an empty country part; it counts as known but foreign.
    """
    parts = F.transform(codes, country_code)
    return F.array_distinct(F.filter(parts, lambda c: ~c.isin(*NO_COUNTRY)))


def contains_key(name: Column, query: Column) -> Column:
    """Does the name contain the query, by name key?"""
    return F.contains(name, query)
