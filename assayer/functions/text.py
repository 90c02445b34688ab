"""Text functions whose results equal those of Python's str methods."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that str.strip() removes.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
ASCII = r"^[\x00-\x7F]*$"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def nonblank(col: Column) -> Column:
    """Neither null nor white space alone."""
    return col.isNotNull() & (F.length(strip(col)) > 0)


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _label_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.strip()).casefold())


def casefold(col: Column) -> Column:
    """str.casefold(). ASCII text is folded in the JVM; Python sees the rest alone."""
    ascii_only = col.rlike(ASCII)
    return F.when(ascii_only, F.lower(col)).otherwise(_casefold(F.when(~ascii_only, col)))


def label_key(col: Column) -> Column:
    """The key under which labels are equal: stripped, NFKC, case-folded."""
    ascii_only = col.rlike(ASCII)
    return F.when(ascii_only, F.lower(strip(col))).otherwise(_label_key(F.when(~ascii_only, col)))


def label_key_of(label: str) -> str:
    return unicodedata.normalize("NFKC", label.strip()).casefold()


def contains_folded(text: Column, needle: Column) -> Column:
    """Substring test without regard to case."""
    return casefold(text).contains(casefold(needle))
