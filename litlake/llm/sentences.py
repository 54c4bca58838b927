"""Problem 9: sentence boundaries across languages and scripts.

Method: the boundary rules are compiled into a finite transducer.  A lexer with
bounded context gives each token a class; the transducer reads classes and emits
a boundary at the end of the token before.  Its states hold what a decision
needs: where in a paragraph or list it is, which brackets and quotes are open
and whether they opened at the start of the unit, and which end mark waits for
the next token.  Rules are stated once, as the function ``_step``; the table of
all reachable states is built from it at import.

A document longer than a chunk may be is cut into chunks at places where no token
can span, and its chunks are spread over all tasks.  Each
chunk is processed as a function from every state to the state at its end and
the boundaries emitted on the way (states merge quickly, so this costs little
more than one run); the functions are composed by a parallel prefix scan, which
gives each chunk its true start state: upwards, ``FAN`` functions at a time are
composed to one, in three levels, which is enough for any text that a row can hold;
downwards, each level's start states give those of the level below.  A document
of one chunk needs no function, as its start state is known.

Rules in short: blank lines always end a unit; a list entry is its line; a full
stop ends a unit unless it belongs to an abbreviation, a number, a name or an
ellipsis that goes on in lower case; quotes and brackets opened inside a unit
hide the end marks in them; a bracket opened at the start of a unit is a unit of
its own; marks that stay open over more than ``HIDDEN`` ends were never meant to
close, so the next end counts and they are given up; marks opened inside ``HELD``
others are counted, up to ``OVER`` of them, until they are closed; a quotation at the start that is followed by its speaker goes on; Thai
units end at the space between two Thai runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.session import written

#: Characters per chunk, about, and how much longer one gets in search of a safe cut.
CHUNK, SEARCH = 16_384, 16_384
#: Functions composed at a time in the scan.  A row's text has less than 2**31 characters, hence less than FAN**3 chunks.
FAN = 64
#: Open marks whose kind and place are kept, further ones that are counted, and unit ends that open marks may hide.
HELD, OVER, HIDDEN = 2, 3, 2

# Abbreviations.  The first never end a unit, the second end one
# before a capital letter or a number, the third (months, numbers) are
# abbreviations only before a digit.
NEVER = (
    "Dr Prof Mr Mrs Ms St Mme Mlle Sr Sra Srta Dra Gen Col Capt Lt Sgt Rev Hon Gov Sen Rep Pres Mt Ft Ph "
    "Fig Figs Eq Eqs Vol Vols App Sec Secs Sect Ch Chap Tab Ref Refs Abb Kap Nr Bd Hrsg Aufl "
    "fig figs eq eqs vol vols chap pp p pg núm nro pág págs vid "
    "vs cf al approx incl viz ca vgl bzw env aprox ej ex resp. e.g i.e z.B d.h u.a u.ä s.o s.u i.d.R c.-à-d p.ej p.ex v.a o.ä "
    "sog evtl ggf inkl insb usf Hr Fr Dipl Ing Mag phil nat"
).split()
ENDING = "etc Inc Ltd Co Corp Jr Sr resp usw u.s.w u.s.f a.m p.m A.M P.M Ph.D M.D B.A M.A B.Sc M.Sc U.S U.K U.N E.U D.C Bros Univ Dept Est".split()
BEFORE_DIGIT = "app sec ch tab ref refs art ed eds no cap Art Tab Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec No Nos Nr art núm Lief Jahrg".split()
ORDINAL_BEFORE = "im am vom zum zur der den dem des das die bis seit ab und".split()

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЀ-Џ"
_CASED = "A-Za-zÀ-ÖØ-öø-ɏͰ-Ͽἀ-῿Ѐ-ӿ"
_HAN = "々〇㐀-䶿一-鿿豈-﫿ぁ-ゟ゠-ヿㇰ-ㇿ가-힣𠀀-𯿿"
_THAI = "ก-ฺเ-๎"
_WORD = rf"[{_CASED}](?:[\w'’\-–&]*[\w])?(?:[./:@][a-z0-9][\w\-]*)*"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))


#: Token classes in the order in which the lexer tries them: (class, pattern).
_LEXER = (
    ("BREAK", r"\n[ \t\r\xa0　]*\n\s*"),
    ("BULLET", r"^[ \t]*(?:[-*•‣▪–]|#{1,6})(?=[ \t])"),
    ("MARK", r"^[ \t]*(?:\(?\d{1,3}[.)]|[（(][一二三四五六七八九十]+[)）])(?=[ \t])"),
    ("NL", r"\n"),
    ("WS", r"[^\S\n]+"),
    ("LOW", r"[a-z]+,?(?: [a-z]+,?)*(?![\w.'’\-@/:&]| \d)"),
    # The usual words, before the many patterns of the unusual ones.
    ("LOW", rf"(?!(?:{_any([w for w in (*NEVER, *ENDING, *BEFORE_DIGIT) if w.isalpha() and w.isascii() and w.islower() and len(w) > 4])})\.)[a-z]{{5,}}(?=[.!?…]?(?:\s|\Z))(?!\s\d)"),
    ("UP", r"[A-Z][a-z]*(?![\w.:/@'’\-–&]|\s+\d)"),
    ("CJK", rf"[{_HAN}]+"),
    ("THAI_END", rf"[{_THAI}ๆ-๏]+(?=\s+[{_THAI}])"),
    ("CJK", rf"[{_THAI}ๆ-๏]+"),
    ("NUM", r"[.,]?\d(?:[\d.,:/–\-]*\d)?(?:[%‰°]|\.?[ºª]|[a-z]+)*"),
    ("ELL", r"\.(?:[ \xa0]?\.)+|…+"),
    ("CTERM", r"[。｡！？．।॥؟۔]+"),
    ("TERM", r"[.!?‼⁇⁈⁉]+"),
    ("LOW", rf"\b(?:{_any(ORDINAL_BEFORE)})\s+\d{{1,2}}\.(?=\s)"),
    ("UP", rf"\b(?:{_any([w.capitalize() for w in ORDINAL_BEFORE])})\s+\d{{1,2}}\.(?=\s)"),
    ("ABE_U", rf"(?:{_any([w for w in ENDING if w[0].isupper()])})\.(?![\w])"),
    ("ABE_L", rf"(?:{_any([w for w in ENDING if not w[0].isupper()])})\.(?![\w])"),
    ("UP", rf"(?:{_any([w for w in NEVER if w[0].isupper()])})\.(?!\w)"),
    ("LOW", rf"(?:{_any([w for w in NEVER if not w[0].isupper()])})\.(?!\w)"),
    ("UP", rf"(?:{_any([w for w in BEFORE_DIGIT if w[0].isupper()])})\.(?=\s*\d)"),
    ("LOW", rf"(?:{_any([w for w in BEFORE_DIGIT if not w[0].isupper()])})\.(?=\s*\d)"),
    ("UP", rf"\b[{_UP}]\.(?=[\s\-]*[{_UP}]|-)"),
    ("LOW", r"\b[a-zà-ÿ]\.(?:\s?[A-Za-zÀ-ÿ]\.)*(?=\s|,)"),
    ("OTHL", r"(?:डॉ|प्रो|श्री|सुश्री|कृ|पं)\."),
    ("LOW", r"https?://[^\s<>\"”“«»　-鿿＀-￯]*[\w/]"),
    ("NAME", r"[a-z][a-z0-9\-]*(?=\s\d+\.\d)"),
    ("UP", rf"[{_UP}][\w'’\-–&]*(?:[./:@][a-z0-9][\w\-]*)*"),
    ("LOW", _WORD),
    ("OPB_U", rf"[(\[{{](?=\s*[\"“‘«]?[{_UP}])|[（【〔［｛]"),
    ("OPB", r"[(\[{]"),
    ("CLB", r"[)\]}）】〕］｝]"),
    ("OPQ", r"[„‚«「『《〈｢]|“(?=[\w¿¡‘(\[《『「])|(?<![\w.,!?…)])\"(?=[\w¿¡])"),
    ("CLQ", r"[”»」』》〉｣“\"]"),
    ("OPS", r"‘(?=\w)"),
    ("CLS", r"[’‘]"),
    ("INV", r"[¿¡]"),
    ("OTHL", r"[^\W\d_A-Za-z]+[̀-ͯऀ-ॣ०-ॿ؀-ۿ]*(?:[^\W\d_A-Za-z]|[ऀ-ॣ०-ॿ])*"),
    ("OTHER", r"\S"),
)
CLASSES = sorted({c for c, _ in _LEXER}) + ["EOF"]
_CODE = {c: i for i, c in enumerate(CLASSES)}
_SCAN = re.compile("|".join(f"({p})" for _, p in _LEXER), re.M)
assert _SCAN.groups == len(_LEXER), "patterns must not hold capturing groups"
_OF_GROUP = [0] + [_CODE[c] for c, _ in _LEXER]

_UPPER = {"UP", "ABE_U", "NAME", "INV"}
_LOWER = {"LOW", "ABE_L"}
_SCRIPT = {"CJK", "THAI_END"}

# A state is (mode, started, open, waiting).
#   mode      P paragraph start, L line after a list entry, I in a list entry or heading line, B elsewhere
#   started   the unit has a token
#   open      up to HELD open marks, each a pair of kind (q quote, h single quote, b bracket) and s or m: opened at the unit's start or in it
#   waiting   '' or the end mark before: T full stop etc., C of a script without capitals, E ellipsis, A abbreviation,
#             QS QM quote closed after an end mark, BS bracket closed after one
#   over      further marks that are open within those
#   hidden    unit ends that the open marks have hidden so far
State = tuple[str, bool, tuple[str, ...], str, int, int]
START: State = ("P", False, (), "", 0, 0)


def _ends(waiting: str, cls: str) -> bool:
    """Whether a waiting end mark ends the unit before a token of this class."""
    if cls in _UPPER or cls in ("OPQ", "OPS"):
        return True
    if cls == "OPB_U":
        return True
    if cls == "OPB":
        return waiting in ("C", "QM", "BS")
    if cls in _LOWER:
        return waiting == "C"
    if cls == "NUM":
        return True
    if cls in _SCRIPT or cls == "OTHL":
        return waiting != "QS" and waiting != "A"
    return False


def _step(state: State, cls: str) -> tuple[State, bool]:
    """The state after a token of class ``cls``, and whether a unit ends before it."""
    mode, started, stack, waiting, over, hidden = state
    if cls in ("BREAK", "EOF"):
        return START, started
    if mode == "I" and cls != "WS":
        return (("L", False, (), "", 0, 0), started) if cls == "NL" else (("I", True, (), "", 0, 0), False)
    if cls in ("NL", "WS"):
        return state, False
    if cls in ("BULLET", "MARK"):
        if not started and mode in "PL":
            return ("I", True, (), "", 0, 0), False
        if cls == "BULLET" and not stack and waiting:
            return ("I", True, (), "", 0, 0), True
        cls = "OTHER" if cls == "BULLET" else "LOW"
    emit = False
    if waiting and cls not in ("TERM", "ELL", "CTERM", "CLQ", "CLB", "CLS"):
        emit = _ends(waiting, cls)
        if emit and stack:
            hidden += 1
            if emit := hidden > HIDDEN:
                stack, over, hidden = (), 0, 0
        if emit:
            started = False
        if emit or not stack:
            waiting = ""
    mode = "B"
    where = "m" if started else "s"
    if cls in ("OPQ", "OPS", "OPB", "OPB_U"):
        kind = {"OPQ": "q", "OPS": "h"}.get(cls, "b")
        if len(stack) < HELD:
            stack = (*stack, kind + where)
        else:
            over = min(over + 1, OVER)
        return (mode, True, stack, "", over, hidden), emit
    if cls in ("CLQ", "CLS", "CLB"):
        kind = {"CLQ": "q", "CLS": "h"}.get(cls, "b")
        if over:
            return (mode, True, stack, "T" if waiting else "", over - 1, hidden), emit
        at = max((i for i, x in enumerate(stack) if x[0] == kind), default=None)
        if at is None:  # a stray mark belongs to the unit and changes nothing
            return (mode, True, stack, waiting, over, hidden), emit
        closed, stack = stack[at], stack[:at]
        if not waiting:
            after = ""
        elif stack:
            after = "T"
        elif closed[0] == "b":
            after = "BS" if closed[1] == "s" else ""
        else:
            after = "QS" if closed[1] == "s" else "QM"
        return (mode, True, stack, after, over, hidden if stack else 0), emit
    if cls == "TERM":
        after = "C" if waiting == "C" else "T"
    elif cls == "CTERM" or (cls == "THAI_END" and not stack):
        after = "C"
    elif cls == "ELL":
        after = "C" if waiting == "C" else "E"
    else:
        after = "A" if cls in ("ABE_U", "ABE_L") else ""
    return (mode, True, stack, after, over, hidden), emit


def _compile() -> tuple[list[State], np.ndarray, np.ndarray]:
    """All reachable states with their tables of next states and emissions."""
    states, queue = {START: 0}, [START]
    moves = {}
    while queue:
        state = queue.pop()
        for cls in CLASSES:
            after, emit = _step(state, cls)
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            moves[states[state], _CODE[cls]] = (states[after], emit)
    following = np.zeros((len(states), len(CLASSES)), dtype=np.int32)
    emits = np.zeros((len(states), len(CLASSES)), dtype=bool)
    for (s, c), (after, emit) in moves.items():
        following[s, c], emits[s, c] = after, emit
    return list(states), following, emits


STATES, _NEXT, _EMIT = _compile()
_NEXT_ROWS, _EMIT_ROWS = _NEXT.tolist(), _EMIT.tolist()
_CUT = re.compile(
    rf"\n[ \t]*\n\s*|(?<=[a-z,] )(?=[a-z]{{4,}},? [a-z])|(?<=[{_HAN}])(?=[{_HAN}])|(?<=[{_THAI}])(?=[{_THAI}]{{2}})|(?<=[ऄ-ह] )(?=[ऄ-ह])"
)


def chunks(text: str, size: int = CHUNK) -> list[tuple[int, int, int]]:
    """(start, end, end of the last non-space character before start) of the chunks of ``text``."""
    out, start = [], 0
    while start < len(text):
        end = len(text)
        if end - start > size + SEARCH:
            found = _CUT.search(text, start + size, min(end, start + size + SEARCH))
            end = found.end() if found else start + size + SEARCH
            if not found:  # no safe place: the token that starts here stays whole
                end = next((m.start() for m in re.compile(r"\s").finditer(text, end)), len(text))
        before = start
        while before and text[before - 1].isspace():
            before -= 1
        out.append((start, end, before))
        start = end
    return out


def run_from(text: str, state: int, before: int = 0, offset: int = 0, last: bool = True) -> tuple[int, list[int]]:
    """(state at the end, ends of units) of a chunk entered in ``state``."""
    ends, end = [], before
    following, emits, kinds = _NEXT_ROWS, _EMIT_ROWS, _OF_GROUP
    newline = _CODE["NL"]
    for m in _SCAN.finditer(text):
        c = kinds[m.lastindex]
        if emits[state][c]:
            ends.append(end)
        state = following[state][c]
        if c != newline:
            stop = m.end()
            if text[stop - 1] != "\n" and not text[stop - 1].isspace():
                end = offset + stop
    if last:
        if emits[state][_CODE["EOF"]]:
            ends.append(end)
        state = following[state][_CODE["EOF"]]
    return state, ends


def chunk_function(text: str, before: int, offset: int, last: bool) -> tuple[list[int], list[int], list[list[int]]]:
    """The chunk as a function: per start state its end state and the number of its list of ends; the lists."""
    current = np.arange(len(STATES), dtype=np.int32)
    shown: list[tuple[int, np.ndarray]] = []
    end, newline, stop = before, _CODE["NL"], None
    for n, m in enumerate(_SCAN.finditer(text)):
        c = _OF_GROUP[m.lastindex]
        emit = _EMIT[current, c]
        if emit.any():
            shown.append((end, emit))
        current = _NEXT[current, c]
        if c != newline and not text[m.end() - 1].isspace():
            end = offset + m.end()
        if n % 16 == 15 and (current == current[0]).all():
            stop = m.end()
            break
    tail: list[int] = []
    if stop is not None:  # all states have merged
        final, tail = _rest(text, stop, int(current[0]), end, offset, last)
        current = np.full(len(STATES), final, dtype=np.int32)
    elif last:
        emit = _EMIT[current, _CODE["EOF"]]
        if emit.any():
            shown.append((end, emit))
        current = _NEXT[current, _CODE["EOF"]]
    if not shown:
        return current.tolist(), [0] * len(STATES), [tail]
    matrix = np.array([e for _, e in shown]).T
    kinds, which = np.unique(matrix, axis=0, return_inverse=True)
    lists = [[p for (p, _), e in zip(shown, row, strict=True) if e] + tail for row in kinds]
    return current.tolist(), which.reshape(-1).tolist(), lists


def _rest(text: str, start: int, state: int, end: int, offset: int, last: bool) -> tuple[int, list[int]]:
    ends, newline = [], _CODE["NL"]
    for m in _SCAN.finditer(text, start):
        c = _OF_GROUP[m.lastindex]
        if _EMIT_ROWS[state][c]:
            ends.append(end)
        state = _NEXT_ROWS[state][c]
        if c != newline and not text[m.end() - 1].isspace():
            end = offset + m.end()
    if last:
        if _EMIT_ROWS[state][_CODE["EOF"]]:
            ends.append(end)
        state = _NEXT_ROWS[state][_CODE["EOF"]]
    return state, ends


def sentence_ends(text: str, size: int = CHUNK) -> list[int]:
    """Ends of the units of one text, by the same chunks and scan as the operator."""
    state, out = 0, []
    parts = chunks(text, size)
    for n, (start, end, before) in enumerate(parts):
        if n == 0:
            state, ends = run_from(text[:end], 0, 0, 0, n == len(parts) - 1)
        else:
            following, which, lists = chunk_function(text[start:end], before, start, n == len(parts) - 1)
            ends, state = lists[which[state]], following[state]
        out.extend(ends)
    return out


def _cut(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, tag, text in zip(batch["key"], batch["tag"], batch["text"], strict=True):
                parts = chunks(text, size)
                rows = [(key, tag, n, n == len(parts) - 1, s, b, text[s:e]) for n, (s, e, b) in enumerate(parts)]
                yield pd.DataFrame(rows, columns=["key", "tag", "chunk", "last", "start", "before", "text"])

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if r.chunk == 0:  # entered in one state only
                state, ends = run_from(r.text, 0, 0, 0, r.last)
                rows.append((r.key, r.tag, r.chunk, [state], [0], [ends]))
            else:
                rows.append((r.key, r.tag, r.chunk, *chunk_function(r.text, r.before, r.start, r.last)))
        yield pd.DataFrame(rows, columns=["key", "tag", "chunk", "following", "which", "lists"])


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "tag": batch["tag"], "ends": [run_from(t, 0)[1] for t in batch["text"]]})


def _composed(parts: str) -> Column:
    """The function that applies those of the array ``parts`` in turn."""
    first = F.element_at(parts, 1)["following"]
    return F.aggregate(F.slice(parts, 2, FAN), first, lambda now, p: F.transform(now, lambda state: F.element_at(p["following"], state + 1)))


def _starts(parts: str, start: Column) -> Column:
    """(place, start) for each function of ``parts``, the first of which starts in ``start``."""
    after = lambda seen, p: F.concat(seen, F.array(F.element_at(p["following"], F.element_at(seen, -1) + 1)))
    states = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array(start), after)
    return F.zip_with(parts, states, lambda p, s: F.struct(p["place"].alias("place"), s.alias("start")))


def prefix_scan(functions: DataFrame) -> DataFrame:
    """(tag, chunk, start): the start state of each chunk of ``functions`` (tag, chunk, following), a table that is cheap to read again.

    No task ever holds more than ``FAN`` functions of a text.  Repeated rows count once.
    """

    def gathered(level: DataFrame) -> DataFrame:
        return level.groupBy("tag", F.floor(F.col("place") / FAN).cast("int").alias("group")).agg(
            F.array_sort(F.collect_set(F.struct("place", "following"))).alias("parts")
        )

    levels = [gathered(functions.select("tag", F.col("chunk").alias("place"), "following"))]
    for _ in range(2):
        levels.append(gathered(levels[-1].select("tag", F.col("group").alias("place"), _composed("parts").alias("following"))))
    starts = levels[-1].select("tag", F.inline(_starts("parts", F.lit(0))))
    for level in reversed(levels[:-1]):
        known = starts.select("tag", F.col("place").alias("group"), F.col("start").alias("__start"))
        starts = level.join(known, ["tag", "group"]).select("tag", F.inline(_starts("parts", F.col("__start"))))
    return starts.select("tag", F.col("place").alias("chunk"), "start")


def sentences(documents: DataFrame, key: str, text: str = "text", size: int = CHUNK, distinct: bool = True) -> DataFrame:
    """(key, sent_end): one row per unit, sent_end in code points from the start of the text.

    Null, empty and blank texts have no units.  Rows with equal key and text
    count once; with equal key and other text, each text by itself.  ``distinct``
    may be False if no row is repeated: then texts of one chunk are never shuffled.
    """
    kind = dict(documents.dtypes)[key]
    ready = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    # Two 64-bit hashes name a key's text.
    ready = ready.withColumn("tag", F.concat_ws(" ", F.xxhash64("key", "text"), F.xxhash64(F.lit(1), "key", "text")))
    short = F.char_length("text") <= size + SEARCH
    whole = ready.where(short).mapInPandas(_whole, f"key {kind}, tag string, ends array<int>")
    if distinct:
        whole = whole.dropDuplicates(["tag"])
    cut = ready.where(~short).mapInPandas(_cut(size), f"key {kind}, tag string, chunk int, last boolean, start int, before int, text string")
    mapped = f"key {kind}, tag string, chunk int, following array<int>, which array<int>, lists array<array<int>>"
    functions = written(cut.repartition("tag", "chunk").mapInPandas(_functions, mapped))
    known = prefix_scan(functions).withColumnRenamed("start", "state")
    ends = F.element_at("lists", F.element_at("which", F.col("state") + 1) + 1)
    long = functions.dropDuplicates(["tag", "chunk"]).join(known, ["tag", "chunk"]).select("key", "tag", ends.alias("ends"))
    found = whole.unionByName(long).select("key", F.explode(F.array_distinct("ends")).alias("__end"))
    return found.select(F.col("key").alias(key), F.col("__end").cast("long").alias("sent_end"))
