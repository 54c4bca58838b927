"""Several values packed in one field.

Method: the field is split on its quote characters.  Odd pieces are literals and
are kept whole; even pieces are split on delimiters; array folds put the values
back together in their order, and ``posexplode`` gives each its ordinal.  All of
it is one chain of built-in expressions, so it runs inside the scan's stage
without a shuffle; only non-ASCII fields visit Python, for NFKC.

Notation understood (none of it is part of a value): a lead-in label, one pair
of square brackets around the whole field, list marks at line starts, straight
or curly double quotes, single quotes inside brackets, doubled quotes,
backslash escapes including ``\\uXXXX``, and a full stop at the end.
Delimiters: comma, semicolon, bar, enumeration comma, tab, line feed, their
full-width forms, and slash or middle dot between spaces.  Slash, hyphen, ``&``
and apostrophe inside a value stay.

Null fields, empty fields and fields of delimiters only give no row.  Equal
values in one field give a row each.  Unbalanced quotes are ordinary characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.unicode import SPACE, nfkc_lower, squeeze

# Private-use characters that stand for notation while a field is taken apart.
_EDGE, _DQ, _SQ, _BS, _LIST = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"

_DELIM = r"[,;|\n\t、]"
_SPLIT = rf"{_DELIM}|(?<=\s)[/·•](?=\s)"
_BEFORE = rf"(?<=^|{_LIST}|{_DELIM}|\s[/·•])( *+)"
_AFTER = rf"(?= *+(?:$|{_DELIM}|[/·•]\s))"
_LABEL = r"^\s*(?:key\s*-?\s*words?(?:\s+and\s+phrases)?|index\s+terms|关键词|关键字|キーワード)\s*(?:[:—–]|-(?=\s))\s*"
_MARK = rf"(?m)^({_LIST}?)[ \t]*(?:[-–•*‣▪◦·]|\(?\d{{1,3}}[.)])[ \t]+"
_HEX = r"\\u[0-9a-f]{4}"



def _decode_hex(field: Column) -> Column:
    r"""``\uXXXX`` runs become their characters; quotes among them stay literal."""
    cut = rf"(?i)(?<={_HEX})(?!\\u[d][c-f])|(?={_HEX})(?<!\\u[d][89ab][0-9a-f]{{2}})"
    decoded = F.transform(
        F.split(field, cut),
        lambda p: F.when(
            p.rlike(rf"(?i)^(?:{_HEX})+$"),
            F.replace(F.decode(F.unhex(F.regexp_replace(p, r"\\u", "")), "UTF-16BE"), F.lit('"'), F.lit(_DQ)),
        ).otherwise(p),
    )
    return F.when(field.contains("\\u"), F.array_join(decoded, "")).otherwise(field)


def _prepare(column: Column) -> Column:
    """Escapes of whole characters resolved, then NFKC and lower case."""
    return nfkc_lower(_decode_hex(column))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _replace(field: Column, steps: tuple[tuple[str, str], ...], *signs: str) -> Column:
    """The replacements one after the other; skipped for fields that hold none of the signs they need."""

    def run(x: Column) -> Column:
        out = x
        for pattern, new in steps:
            out = F.regexp_replace(out, pattern, new)
        return F.when(reduce(lambda p, q: p | q, [x.contains(s) for s in signs]), out).otherwise(x)

    return _bound(field, run)


def _take_apart(field: Column) -> Column:
    field = F.regexp_replace(F.replace(field, F.lit("\r"), F.lit("\n")), r"(?U:[^\S\n\t])", " ")
    field = F.regexp_replace(F.regexp_replace(field, _LABEL, ""), r"^\s+|[\s.。]+$", "")
    field = _replace(field, ((r"(?s)^\[(.*)\]$", f"{_LIST}$1"),), "[")
    field = F.regexp_replace(field, _MARK, "$1")
    escapes = ((r"\\\\", _BS), (r'\\"', _DQ), (r"\\'", _SQ), (r"\\(?:[nrt]|xa0)", " "))
    field = _replace(field, escapes, "\\")
    # A doubled quote beside a character of the value is that value's own quote.
    field = _replace(field, ((r'""(?=[^\s,;|、"\]])|(?<=[^\s,;|、"\[])""', _DQ),), '""')
    field = _replace(field, ((rf'{_BEFORE}["“]([^"“”]*+)["”]{_AFTER}', f"$1{_EDGE}$2{_EDGE}"),), '"', "“")
    field = _replace(field, ((rf"{_BEFORE}'([^']*+)'{_AFTER}", f"$1{_EDGE}$2{_EDGE}"),), _LIST)
    values = F.flatten(
        F.transform(
            F.split(field, _EDGE), lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(F.split(p, _SPLIT))
        )
    )
    values = F.transform(values, lambda v: squeeze(F.translate(v, _DQ + _SQ + _BS + _LIST, "\"'\\")))
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def split_packed(column: Column) -> Column:
    """The values of one packed field, in order, each in normal form, as an array (empty for null)."""
    return _take_apart(_prepare(column))


def explode_packed(df: DataFrame, column: str, keep: list[str], ordinal: str = "ord", item: str = "item") -> DataFrame:
    """One row per value of ``column``: the columns ``keep``, the value's place from 1 and the value.

    Columns of ``df`` that are not kept may have any name, also those of the result.
    """
    kept = [F.col(f"`{k}`") for k in keep]
    prepared = df.select(*kept, _prepare(F.col(f"`{column}`")).alias("__field"))
    values = prepared.select(*kept, F.posexplode(_take_apart(F.col("__field"))).alias("__place", "__value"))
    return values.select(*kept, (F.col("__place") + 1).cast("int").alias(ordinal), F.col("__value").alias(item))


__all__ = ["SPACE", "explode_packed", "split_packed"]
