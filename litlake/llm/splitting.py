"""Problem 1: splitting oversized items at natural boundaries.

Method: balanced targets.  From the smallest number of pieces that can hold the
text, targets of equal length are placed; each cut is snapped to the strongest
boundary near its target (paragraph, sentence, line, word; sentences are those of
problem 9's transducer); when some cut can't
keep to the limits at a boundary, pieces are added and all targets are placed
anew.  If that fails ``ADDED`` times, the cuts that reach as far as boundaries allow
are taken; only where there is no boundary at all within a limit is a text cut between characters.  Every piece but the first starts exactly ``overlap`` characters before
the end of the one before, so the pieces give the text back without loss.

Only texts over their limit leave the JVM; sizes are code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.sentences import sentence_ends

#: A paragraph: lines that hold more than spaces, without a blank line between them.
_PARAGRAPH = re.compile(r"(?:^ *[^\n ][^\n]*(?:\n|\Z))+", re.M)
#: Boundaries, strongest first; a cut stands at the end of the match.
_BOUNDARIES = (
    ("paragraph", re.compile(r"\n(?: *\n)+")),
    ("sentence", None),
    ("line", re.compile(r"\n+")),
    ("word", re.compile(r"\s+|(?<=[，、；：,;:])")),
)
#: Pieces added one by one while targets are balanced.
ADDED = 3


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs, without line feeds at the end."""
    return [(m.start(), m.end() - (text[m.end() - 1] == "\n")) for m in _PARAGRAPH.finditer(text)]


def _sentences(text: str) -> list[int]:
    """Where sentences begin that follow another, in order."""
    starts = []
    for end in sentence_ends(text):
        while end < len(text) and text[end].isspace():
            end += 1
        starts.append(end)
    return starts


def _farthest(text: str, stops: list[int], limit: int, overlap: int) -> list[tuple[int, int, str]] | None:
    """Pieces that each reach to the last boundary within the limit; None if there is a piece without one."""
    kinds: dict[int, str] = {}
    for kind, pattern in reversed(_BOUNDARIES):
        kinds.update(dict.fromkeys(stops if pattern is None else (m.end() for m in pattern.finditer(text)), kind))
    places, pieces, start = sorted(kinds), [], 0
    while len(text) - start > limit:
        i = bisect_right(places, start + limit) - 1
        if i < 0 or places[i] <= start + overlap:
            return None
        pieces.append((start, places[i], kinds[places[i]]))
        start = places[i] - overlap
    return [*pieces, (start, len(text), "end")]


def _snap(text: str, stops: list[int], low: int, high: int, target: int) -> tuple[int, str] | None:
    """The strongest boundary in [low, high], the nearest to ``target`` of its kind; near the target first, then anywhere allowed."""
    near = max(1, min(target - low, high - target, (high - low) // 3))
    for first, last in ((max(low, target - near), min(high, target + near)), (low, high)):
        for kind, pattern in _BOUNDARIES:
            if pattern is None:
                ends = stops[bisect_left(stops, first) : bisect_right(stops, last)]
            else:
                ends = [m.end() for m in pattern.finditer(text, max(0, first - 1), last) if first <= m.end() <= last]
            if ends:
                return min(ends, key=lambda e: (abs(e - target), e)), kind
    return None


def _try(text: str, stops: list[int], limit: int, overlap: int, count: int, hard: bool) -> list[tuple[int, int, str]] | None:
    size, pieces, start = len(text), [], 0
    for i in range(count - 1):
        target = overlap + round((size - overlap) * (i + 1) / count)
        low = max(start + overlap + 1, size - (count - 1 - i) * (limit - overlap))
        high = min(start + limit, size - 1)
        if low > high:
            return None
        target = min(max(target, low), high)
        cut = _snap(text, stops, low, high, target)
        if cut is None:
            if not hard:
                return None
            while low < target and unicodedata.combining(text[target]):
                target -= 1
            cut = (target, "char")
        pieces.append((start, *cut))
        start = cut[0] - overlap
    return [*pieces, (start, size, "end")]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of ``text``; one piece if it fits.

    ``overlap`` must be less than ``limit``.  A text without any boundary is cut
    between characters, before no combining mark while that is possible.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap less than limit")
    if len(text) <= limit:
        return [(0, len(text), "end")] if text else []
    least = -(-(len(text) - overlap) // (limit - overlap))
    stops = _sentences(text)
    for more in range(ADDED + 1):
        if pieces := _try(text, stops, limit, overlap, least + more, hard=False):
            return pieces
    if pieces := _farthest(text, stops, limit, overlap):
        return pieces
    for more in range(ADDED + 1):
        if pieces := _try(text, stops, limit, overlap, least + more, hard=True):
            return pieces
    raise AssertionError("unreachable: equal pieces always keep to the limit")


def _split(keys: list[str], with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            labels = zip(*(batch[k] for k in keys), strict=True)
            for label, text, limit, overlap in zip(labels, batch["text"], batch["max_size"], batch["overlap"], strict=True):
                pieces = split_text(text, int(limit), int(overlap))
                spans = paragraphs(text)
                starts = [s for s, _ in spans]
                for n, (start, end, kind) in enumerate(pieces, 1):
                    # The paragraph that the cut at ``end`` goes through, if any.
                    k = bisect_left(starts, end) - 1
                    through = n < len(pieces) and k >= 0 and spans[k][0] < end < spans[k][1]
                    place = (k + 1, spans[k][1] - spans[k][0]) if through else (None, None)
                    rows.append((*label, n, len(pieces), start, end, kind, *place, *([text[start:end]] if with_text else [])))
            columns = [*keys, "piece_no", "pieces", "start", "end", "cut", "para_no", "para_chars", *["piece"] * with_text]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"para_no": "Int32", "para_chars": "Int64"})

    return run


def split_oversized(items: DataFrame, keys: list[str], with_text: bool = True) -> DataFrame:
    """Pieces of the items whose ``text`` is longer than their ``max_size``.

    ``items`` has the columns ``keys``, text, max_size and overlap.  Null texts,
    null limits and items that fit give no row.  Columns of the result: the keys,
    piece_no from 1, pieces, start and end (code points from 0), cut, para_no and
    para_chars (number from 1 and length of the paragraph that the cut goes
    through; null for a cut between paragraphs) and, if asked for, piece.
    """
    needed = items.select(*[F.col(f"`{k}`") for k in keys], "text", "max_size", "overlap")
    kinds = dict(needed.dtypes)
    schema = ", ".join(
        [*(f"`{k}` {kinds[k]}" for k in keys), "piece_no int, pieces int, start long, end long, cut string, para_no int, para_chars long"]
        + ["piece string"] * with_text
    )
    return needed.where(F.char_length("text") > F.col("max_size")).mapInPandas(_split(keys, with_text), schema)


