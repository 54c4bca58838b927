"""Unicode normal forms.

Spark has no built-in NFKC.  ASCII strings are their own NFKC form, so only the
others cross to Python; for ASCII rows the Arrow column holds nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Everything that str.split() takes for white space, as a Java character class.
SPACE = r"(?U:[\s\x1c-\x1f\x85])"


@F.pandas_udf(T.StringType())
def _nfkc_lower(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def is_ascii(column: Column) -> Column:
    return F.octet_length(column) == F.char_length(column)


def nfkc_lower(column: Column) -> Column:
    """NFKC, then lower case; null stays null."""
    other = _nfkc_lower(F.when(~is_ascii(column), column))
    return F.when(is_ascii(column), F.lower(column)).otherwise(other)


def nfkc(column: Column) -> Column:
    """NFKC; null stays null."""
    other = _nfkc(F.when(~is_ascii(column), column))
    return F.when(is_ascii(column), column).otherwise(other)


def squeeze(column: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(column, SPACE + "+", " "))


def normal_form(column: Column) -> Column:
    """NFKC, lower case, white space squeezed and trimmed."""
    return squeeze(nfkc_lower(column))
