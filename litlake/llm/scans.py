"""Problem 5: noise in text from scanned pages.

Method: words that the collection hardly knows are looked up in a trie of its
vocabulary by a Levenshtein automaton.  Its edits are the substitution, insertion and
deletion of any letter, and the confusions of optical recognition, merges and splits
(rn and m, cl and d, ri and n) among them, which count as one edit each.  Trie and
automaton are walked together, so all
candidates within two edits are found, and no others are looked at.  Which of them count
is decided as over a noisy channel: a confusion is far more likely than any other
edit, so a candidate reached by confusions alone must be ``RATIO`` times as frequent as
the word, and ``GENERAL`` times for each other edit.  A branch of the trie that holds
no word frequent enough is not entered.  What is left is
ranked by edits, by use in the same paper (the context) and in the
collection.  Then page furniture (running lines, page numbers) is removed, words
broken at line ends are joined, and lines are put together to paragraphs.

Counts are taken over all words of the collection in a first pass.  The words that
make up at least one in ``VOCABULARY`` of all words, at most ``VOCABULARY`` of them
whatever the size, are broadcast.  A second pass lists the words of each item that are
not known for certain; all distinct ones are corrected in parallel.  Their counts, and
candidates too rare for the broadcast table, come
from the complete table of counts by joins, so every decision is taken on true counts.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.session import written

#: Bound of the broadcast vocabulary; a word must also occur LEAST times.
VOCABULARY, LEAST = 1_000_000, 3
#: A misread word's original must be this many times as frequent, and a word taken for an original at least ANCHOR times.
#: For words of two or three letters, which are near too many others, the ratio is SHORT_RATIO and one edit is allowed.
RATIO, SHORT_RATIO, ANCHOR = 8, 2000, 12
#: The same for each edit that is no confusion: inflected forms and rare words lie one such edit from frequent words.
#: Words with fewer than FULL letters take none.
GENERAL, FULL = 2000, 5
#: Edits allowed in one word.
EDITS = 2
#: Filled lines at each end of a page from which running lines are learned, and among which they are looked for: a page
#: has at most two such lines at an end, and a page number beside them.
LEARNED, EDGE = 2, 3
#: Characters of a running line (a longer one is running text, a shorter one can't be told from any other word) and of a page's number.
RUNNING, NUMBER = (4, 220), 24

# Confusions of optical recognition, as read -> as printed.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("|", "l"), ("1", "i"), ("|", "i"), ("5", "s"), ("@", "a"), ("8", "b"), ("6", "b"), ("9", "g"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("vv", "w"),
    ("w", "vv"), ("b", "ti"), ("ti", "b"), ("o", "0"), ("l", "1"), ("s", "5"), ("li", "h"), ("h", "li"), ("nn", "m"), ("f", "t"), ("t", "f"),
)

#: Letters of all scripts with spaces between words, digits, and marks that scanning puts for letters.
_TOKEN = re.compile(r"[0-9A-Za-z@|ªµºÀ-ÖØ-öø-ʯͰ-ͽͿ-ϿЀ-ҁҊ-֏א-ת؀-ۿऀ-ॿ฀-๿Ḁ-῿]+(?:['’][a-z]+)?")
_NUMBER = re.compile(
    r"(?<![\w@|.])(?=[\dOlIS|.,]*\d)(?=[\d.,]*[OlIS|])[\dOlIS|]+(?:[.,][\dOlIS|]+)+(?![\w@|])"
    r"|(?<![\w@|.])(?=[OlIS|]*\d[OlIS|]*\d)(?=\d*[OlIS|])[\dOlIS|]{3,}(?![\w@|])"
    r"|(?<![\w@|.])[OlIS|]+\.\d+(?![\w@|])|(?<![\w@|.])\d+\.[OlIS|]+(?![\w@|])"
)
#: A cheap test for lines that may hold such a number.
_DIGIT = re.compile(r"\d")
_MIXED = re.compile(r"\d[.,]?[OlIS|]|[OlIS|][.,]?\d")
_HYPHENS = "-‐\xad¬"
_BROKEN = re.compile(rf"([^\W\d_][\w@|]*)[{_HYPHENS}]\s*$")
_PAGE_NO = re.compile(
    r"[\s\-–—\[(·~*]*(?:(?:(?:p|pp|page|seite|página)\b\.?\s*)?(?P<n>[\dOolI|SB]{1,5})(?:\s*(?:/|of|von|de)\s*(?P<of>[\dOolI|SB]{1,5}))?"
    r"|第\s*(?P<z>\d{1,4})\s*页|(?P<r>[ivxlcdm]{1,8}))[\s\-–—\])·~*.]*",
    re.I,
)
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8"})
_STEM = re.compile(r"(20\d\d)_([^_]+)_(.+)", re.S)
# Running lines of papers without venue or year.
_PLAIN_FORMS = ("preprint draft", "preprint", "draft", "manuscript")


def tokens(line: str) -> list[str]:
    """Lower-cased word tokens of a line: runs of letters, digits and the marks that scanning puts for letters."""
    return _TOKEN.findall(line.lower())


_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


def _compounds(text: str) -> list[str]:
    return [c for w in text.split() if "-" in w for c in _COMPOUND.findall(w)]


def needed(n: int, word: str, general: int, edits: int) -> float:
    """Occurrences that an original of ``word`` must have, if that occurs ``n`` times and the original is so many edits away."""
    if not general:
        if len(word) > 3 or any(c in "0158@|" for c in word):
            return max(ANCHOR, RATIO * n)
        return max(ANCHOR, SHORT_RATIO * n) if edits < 2 else float("inf")
    return max(ANCHOR, GENERAL**general * n) if len(word) >= FULL else float("inf")


#: An original that a word may be a misreading of: (edits that are no confusions, all edits, word, place of the first edit, occurrences).
Candidate = tuple[int, int, str, int, int]


class Trie:
    """A vocabulary with its counts as a trie in flat arrays, some 13 bytes a node: the children of a node are neighbours."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.words = sorted(counts)
        words = self.words
        spans, labels = [(0, len(words), 0)], [""]
        self.first, self.final = array("i"), array("i")
        for low, high, depth in spans:  # grows as it is read
            self.first.append(len(spans))
            if low < high and len(words[low]) == depth:
                self.final.append(low)
                low += 1
            else:
                self.final.append(-1)
            while low < high:
                letter, end = words[low][depth], low + 1
                while end < high and words[end][depth] == letter:
                    end += 1
                spans.append((low, end, depth + 1))
                labels.append(letter)
                low = end
        self.first.append(len(spans))
        self.labels = "".join(["\n", *labels[1:]])
        self.counts = array("q", (counts[w] for w in words))
        #: The highest count below each node.
        self.most = array("q", bytes(8 * len(spans)))
        for node in range(len(spans) - 1, -1, -1):
            own = self.counts[self.final[node]] if self.final[node] >= 0 else 0
            self.most[node] = max(own, max(self.most[self.first[node] : self.first[node + 1]], default=0))

    def search(self, word: str, need: Callable[[int, int], float], edits: dict[str, list[tuple[str, str]]]) -> list[Candidate]:
        """The words within ``EDITS`` edits of ``word`` that occur need(edits that are no confusions, edits) times."""
        first, labels, most, final = self.first, self.labels, self.most, self.final
        limits = {(g, e): need(g, e) for e in range(1, EDITS + 1) for g in range(e + 1)}
        limits[0, 0] = min(limits[0, 1], limits[1, 1])  # nothing below is of use to any candidate
        found: dict[int, tuple[int, int, int]] = {}
        size = len(word)
        stack = [(0, 0, 0, 0, size)]  # node, place in the word, edits that are no confusions, edits, place of the first edit
        seen: dict[tuple[int, int, int, int], int] = {}  # of states after an edit, the least place; early edits are walked first
        while stack:
            node, at, general, used, start = stack.pop()
            if used:
                state = (node, at, general, used)
                if seen.get(state, size + 1) <= start:
                    continue
                seen[state] = start
            low, high = first[node], first[node + 1]
            more = used < EDITS and most[node] >= limits[general + 1, used + 1]
            if at == size:
                if used and final[node] >= 0 and self.counts[final[node]] >= limits[general, used]:
                    here = (general, used, start)
                    if here < found.get(final[node], (9, 9, 0)):
                        found[final[node]] = here
            else:
                letter = word[at]
                child = labels.find(letter, low, high)
                if child >= 0 and most[child] >= limits[general, used]:
                    stack.append((child, at + 1, general, used, start))
                if used < EDITS:
                    for read, printed in edits.get(letter, ()):
                        if word.startswith(read, at):
                            below = node
                            for x in printed:
                                below = labels.find(x, first[below], first[below + 1])
                                if below < 0:
                                    break
                            else:
                                if most[below] >= limits[general, used + 1]:
                                    stack.append((below, at + len(read), general, used + 1, min(start, at)))
                if more:
                    stack.append((node, at + 1, general + 1, used + 1, min(start, at)))
            if more:
                limit, place = limits[general + 1, used + 1], min(start, at)
                for child in range(low, high):
                    if most[child] >= limit:
                        stack.append((child, at, general + 1, used + 1, place))
                        if at < size and labels[child] != word[at]:
                            stack.append((child, at + 1, general + 1, used + 1, place))
        return sorted((g, e, self.words[i], p, self.counts[i]) for i, (g, e, p) in found.items())


def _by_first(confusions: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str]]]:
    edits = defaultdict(list)
    for read, printed in confusions:
        edits[read[0]].append((read, printed))
    return edits


class Speller:
    """Decides what words were misread, from counts and candidates."""

    def __init__(self, counts: dict[str, int], total: int | None = None, told: bool = False) -> None:
        """``counts`` of the vocabulary.  ``told``: they are those of words known to be right; candidates come by ``take`` alone."""
        self.counts, self.told = counts, told
        #: Of the item at hand: counts of words that ``counts`` leaves out, and the candidates of words.
        self.rare: dict[str, int] = {}
        self.near: dict[str, list[Candidate]] = {}
        #: From this count on a word is no mere fragment.
        self.common = max(ANCHOR, (sum(counts.values()) if total is None else total) // 100_000)
        self.edits = _by_first(CONFUSIONS)
        self.trie = None if told else Trie({w: n for w, n in counts.items() if n >= ANCHOR and w.isalpha()})
        self.memo: dict[str, list[Candidate]] = {}
        self.known = frozenset(counts) if told else frozenset(w for w in counts if self.original(w) is None)

    def take(self, facts: list[str] | None) -> None:
        """Takes what the complete table of counts says of an item's words; see ``_facts``."""
        self.rare, self.near = {}, {}
        for fact in facts if facts is not None else ():
            word, n, *near = fact.split("\t")
            self.rare[word] = int(n)
            for x in near:
                general, edits, place, count, other = x.split(",")
                self.near.setdefault(word, []).append((int(general), int(edits), other, int(place), int(count)))

    def candidates(self, word: str) -> list[Candidate]:
        """The words frequent enough that ``word`` may be a misreading of."""
        if self.told:
            return self.near.get(word, [])
        if word not in self.memo:
            n = self.count(word)
            self.memo[word] = self.trie.search(word, lambda g, e: needed(n, word, g, e), self.edits)
        return self.memo[word]

    def original(self, word: str, context: Counter | None = None) -> str | None:
        """The word that ``word`` is a misreading of, or None."""
        if len(word) < 2:
            return None
        near = context or {}
        best = min(self.candidates(word), key=lambda x: (x[0], x[1], -min(near.get(x[2], 0), 3), -x[4], x[2]), default=None)
        return best and best[2]

    def place(self, word: str, printed: str) -> int:
        return next((x[3] for x in self.candidates(word) if x[2] == printed), 0)

    def count(self, word: str) -> int:
        """Occurrences in the collection."""
        n = self.counts.get(word)
        return self.rare.get(word, 0) if n is None else n

    def usual(self, word: str) -> bool:
        """Whether the word occurs LEAST times and is no misreading."""
        return word in self.known or (self.count(word) >= LEAST and self.original(word) is None)


def variants(word: str, most: int = EDITS) -> dict[str, tuple[int, int]]:
    """{what may have been printed: (edits, place of the first)} for the readings of ``word`` by up to ``most`` confusions."""
    found: dict[str, tuple[int, int]] = {}
    front = {(word, 0, -1)}
    for edits in range(1, most + 1):
        following = set()
        for text, done, first in front:
            for read, printed in CONFUSIONS:
                place = text.find(read, done)
                while place >= 0:
                    changed = text[:place] + printed + text[place + len(read) :]
                    start = place if first < 0 else first
                    following.add((changed, place + len(printed), start))
                    if changed not in found or (edits, start) < found[changed]:
                        found[changed] = (edits, start)
                    place = text.find(read, place + 1)
        front = following
    return found


def shortened(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters: words within so many edits of each other share one of these."""
    return {"".join(x for i, x in enumerate(word) if i not in drop) for k in range(most + 1) for drop in combinations(range(len(word)), k)}


_SKELETON = (("rn", "m"), ("nn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("ti", "h"), ("li", "h"))
_ONE = str.maketrans("01|5@8ciqvbf", "oll5a8elgyht".replace("5", "s").replace("8", "h"))


def skeleton(text: str) -> str:
    """The text with all confusable shapes made equal, without spaces."""
    text = "".join(text.lower().split())
    for read, printed in _SKELETON:
        text = text.replace(read, printed)
    return text.translate(_ONE)


def _alike(a: str, b: str) -> bool:
    """Whether two skeletons are equal but for one or two places."""
    if a == b:
        return True
    least = min(len(a), len(b))
    if abs(len(a) - len(b)) > 2 or least < 6:
        return False
    # All differences lie within three characters, so one end must agree.
    half = (least - 3) // 2
    if a[:half] != b[:half] and a[-half:] != b[-half:]:
        return False
    start = 0
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return max(len(a), len(b)) - start - end <= 3


_LEADING_NO = re.compile(r"^\W*[\divxlOI|S]{1,5}\W*\s+")
_TRAILING_NO = re.compile(r"\s+\W*[\divxlOI|S]{1,5}\W*$")
_DIVIDER = re.compile(r"\s[·•|:–—-]\s")


class Furniture:
    """Running lines of one paper."""

    def __init__(self, stem: str | None, title: str | None, venue: str | None, year: str | None) -> None:
        named = _STEM.fullmatch(stem or "")
        year = (year or "").strip() or (named[1] if named else "")
        venue = (venue or "").strip() or (named[2] if named else "")
        titles = {" ".join(t.split()) for t in ((title or ""), named[3] if named else "") if t and t.strip()}
        place = f"{venue} {year}".strip()
        heads = {place, f"proceedings of {place}"} if venue and year else {venue} if len(venue) > 3 else set()
        plain = {*_PLAIN_FORMS, *(f"proceedings of {p}" for p in _PLAIN_FORMS)}
        self.whole = {skeleton(h) for h in heads | plain if h}
        self.titles = {skeleton(t) for t in titles}
        self.seen: set[str] = set()

    def learn(self, pages: list[list[tuple[int, str]]]) -> None:
        """Lines that stand at the top or bottom of many pages are running lines, too."""
        filled = [p for p in pages if p]
        times: Counter = Counter()
        for page in filled:
            times.update({skeleton(_bare(t)) for _, t in (*page[:LEARNED], *page[-LEARNED:]) if RUNNING[0] <= len(t) <= RUNNING[1]})
        for line, n in times.items():
            if n >= 3 and n * 2 >= len(filled) and sum(c.isalpha() for c in line) >= 5:
                self.seen.add(line)

    def is_running(self, line: str) -> bool:
        text = line.strip()
        if not RUNNING[0] <= len(text) <= RUNNING[1]:
            return False
        forms = {text}
        if text[0].isdigit() or text[0] in "ivxlOI|S—-[(":
            forms.add(_LEADING_NO.sub("", text))
        if text[-1].isdigit() or text[-1] in "ivxlOI|S—-])":
            forms.add(_TRAILING_NO.sub("", text))
        for form in forms:
            bones = skeleton(form)
            if len(bones) < 4:
                continue
            if bones in self.whole or bones in self.seen or self._begins(bones) or any(_alike(bones, w) for w in self.whole):
                return True
            if place := _DIVIDER.search(form):
                left, right = skeleton(form[: place.start()]), skeleton(form[place.end() :])
                if any(left == w or _alike(left, w) for w in self.whole) and self._begins(right, 3):
                    return True
        return False

    def _begins(self, bones: str, least: int = 10) -> bool:
        """Whether the paper's title starts like this, but for misread characters."""
        size = len(bones)
        if size < least:
            return False
        for title in self.titles:
            if title.startswith(bones) or len(title) >= size - 2 and (
                _alike(bones, title[:size]) or (size > 16 and (_alike(bones, title[: size + 1]) or _alike(bones, title[: size - 1])))
            ):
                return True
        return False


def _bare(line: str) -> str:
    return re.sub(r"^\W*\d{1,4}\W*\s+|\s+\W*\d{1,4}\W*$", "", line.strip())


def _roman(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    numbers = [values[c] for c in text.lower()]
    return sum(-n if i + 1 < len(numbers) and n < numbers[i + 1] else n for i, n in enumerate(numbers))


def page_number(line: str) -> int | None:
    """The number that a line consists of, if it looks like a page's number."""
    text = line.strip()
    if not text or len(text) > NUMBER:
        return None
    m = _PAGE_NO.fullmatch(text)
    if not m:
        return None
    core = re.sub(r"\W", "", text).lower()
    if core and re.fullmatch(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", core):
        return _roman(core)
    number = m["n"] or m["z"]
    if not number or not any(c.isdigit() for c in number):
        return None
    digits = number.translate(_DIGITS)
    return int(digits) if digits.isdigit() else None


def find_furniture(pages: list[list[str]], running: Furniture) -> dict[tuple[int, int], str]:
    """{(page, line): 'header' or 'page_number'}, both from 0."""
    filled = [[(i, t) for i, t in enumerate(lines) if t.strip()] for lines in pages]
    running.learn(filled)
    out: dict[tuple[int, int], str] = {}
    numbers: dict[int, list[tuple[int, int]]] = {}
    for p, lines in enumerate(filled):
        edge = {i: t for i, t in (*lines[:EDGE], *lines[-EDGE:])}
        heads = {i for i, t in edge.items() if running.is_running(t)}
        rest = [i for i, _ in lines if i not in heads]
        out.update({(p, i): "header" for i in heads})
        found = []
        for i in dict.fromkeys((*rest[:1], *rest[-1:])):
            if (n := page_number(pages[p][i])) is not None:
                found.append((i, n))
        numbers[p] = found
    offsets = Counter(n - p for p, found in numbers.items() for _, n in found)
    if offsets:
        best, times = max(offsets.items(), key=lambda x: (x[1], -abs(x[0] - 1)))
        for p, found in numbers.items():
            for i, n in found:
                if n - p == best or (times < 2 and len(found) == 1):
                    out[p, i] = "page_number"
    return out


def _bad_words(line: str, speller: Speller, context: Counter | None) -> list[tuple[str, str]]:
    return [(t, o) for t in tokens(line) if t not in speller.known and not t.isdigit() and (o := speller.original(t, context)) is not None]


def _readable(line: str, speller: Speller) -> tuple[int, int]:
    words = [w for w in tokens(line) if not w.isdigit()]
    return sum(speller.usual(w) or speller.original(w) is not None for w in words), len(words)


def item_furniture(pages: list[list[str]], running: Furniture | None, caption: bool = False) -> dict[tuple[int, int], str]:
    """{(page, line): 'header' or 'page_number'}, both from 0, of a paper's pages or of a caption."""
    furniture = find_furniture(pages, running) if running and not caption else {}
    if caption:
        for i, text in enumerate(pages[0]):
            if running and running.is_running(text):
                furniture[0, i] = "header"
            elif i and i == len(pages[0]) - 1 and page_number(text) is not None:
                furniture[0, i] = "page_number"
    return furniture


def _body(pages: list[list[str]], furniture: dict[tuple[int, int], str]) -> tuple[list[tuple[int, int, str]], list[int], dict[int, int]]:
    """Lines but for furniture, the places of those with text, and the next such place of each."""
    body = [(p, i, t) for p, lines in enumerate(pages) for i, t in enumerate(lines) if (p, i) not in furniture]
    text = [k for k, (_, _, t) in enumerate(body) if t.strip()]
    return body, text, {k: text[n + 1] for n, k in enumerate(text[:-1])}


def _broken(line: str) -> re.Match | None:
    """The word before the mark at the line's end."""
    start = len(line.rstrip()) - 1
    while start > 0 and (line[start - 1].isalnum() or line[start - 1] in "_@|"):
        start -= 1
    return _BROKEN.search(line, start)


def _breaks(body: list[tuple[int, int, str]], text: list[int], after: dict[int, int]) -> Iterator[tuple[int, re.Match, re.Match]]:
    """(line, its last word, first word of the next line) where a line may end inside a word."""
    for k in text:
        line = body[k][2]
        bare = line.rstrip()
        if bare[-1] not in _HYPHENS or k not in after:
            continue
        broken = _broken(line)
        if not broken:
            continue
        m = re.match(r"\s*([^\W\d_][\w@|]*|[0158@|][^\W\d_]+)", body[after[k]][2])
        if m and (m[1][0].islower() or not m[1][0].isalpha() or broken[1].isupper()):
            yield k, broken, m


def asked_words(pages: list[list[str]], furniture: dict[tuple[int, int], str], counts: dict[str, int]) -> set[str]:
    """The words whose counts ``scan_lines`` asks for and that ``counts`` leaves out."""
    body, text, after = _body(pages, furniture)
    asked: set[str] = set()
    for k in text:
        asked.update(tokens(body[k][2]))
    for k, broken, m in _breaks(body, text, after):
        head, tail = broken[1].lower(), m[1].lower()
        asked.update((head, tail, head + tail, f"{head}-{tail}"))
        # What is left of the lines without the broken word, from a word broken before it on.
        for line, start, end in ((body[k][2], 0, broken.start(1)), (body[after[k]][2], m.end(1), None)):
            asked.update(tokens(line[start:end]))
        following = body[after[k]][2]
        if last := _broken(following):
            asked.update(tokens(following[m.end(1) : last.start(1)]))
    return {w for w in asked if w not in counts and not w.isdigit()}


def scan_lines(
    pages: list[list[str]], running: Furniture | None, speller: Speller, caption: bool = False, furniture: dict[tuple[int, int], str] | None = None
) -> tuple[list[tuple[int, int, str]], list[str]]:
    """(findings, paragraphs) of one item: (page from 0, line from 1, noise) and the repaired text."""
    if furniture is None:
        furniture = item_furniture(pages, running, caption)
    findings = {(p, i + 1, kind) for (p, i), kind in furniture.items()}
    body, text, after = _body(pages, furniture)
    repaired = [t for _, _, t in body]
    joined: dict[int, tuple[str, str]] = {}  # line -> (what replaces its broken word, rest of the next line)
    skip_first: dict[int, int] = {}
    skip_last: dict[int, int] = {}
    for k, broken, m in _breaks(body, text, after):
        p, i, line = body[k]
        head, tail = broken[1].lower(), m[1].lower()
        whole, compound = head + tail, f"{head}-{tail}"
        together, apart = speller.count(whole), speller.count(compound)
        if together or apart:
            glue = together >= apart
        else:
            whole_words = all(speller.count(h) >= speller.common or speller.original(h) for h in (head, tail))
            glue = line.rstrip()[-1] != "-" or speller.original(whole) is not None or not whole_words
        if glue:
            findings.add((p, i + 1, "hyphen"))
            joined[k] = (whole, m[1])
            printed = speller.original(whole) if whole not in speller.known else None
            if printed:
                place = speller.place(whole, printed)
                where = (p, i + 1) if place < len(head) else (body[after[k]][0], body[after[k]][1] + 1)
                findings.add((*where, "ocr"))
            skip_last[k] = broken.start(1)
            skip_first[after[k]] = m.end(1)
    context: Counter | None = None
    places = {k: n for n, k in enumerate(text)}
    score: dict[int, tuple[int, int]] = {}

    def readable(k: int) -> bool:
        near = text[max(0, places[k] - 1) : places[k] + 2]
        good = every = 0
        for x in near:
            if x not in score:
                score[x] = _readable(body[x][2], speller)
            good, every = good + score[x][0], every + score[x][1]
        return good * 2 >= every

    for k in text:
        p, i, line = body[k]
        start, end = skip_first.get(k, 0), skip_last.get(k, len(line))
        part = line[start:end] if start or end < len(line) else line
        words = tokens(part)
        if not speller.known.issuperset(words):
            bad = _bad_words(part, speller, None)
            if bad and readable(k):
                findings.add((p, i + 1, "ocr"))
                if context is None:
                    context = Counter(w for _, _, t in body for w in tokens(t))
                for word, _ in bad:
                    printed = speller.original(word, context)
                    repaired[k] = re.sub(rf"(?i)(?<![\w@|]){re.escape(word)}(?![\w@|])", lambda m, o=printed: o.capitalize() if m[0][0].isupper() else o, repaired[k])
        if _DIGIT.search(part) and _MIXED.search(part) and _NUMBER.search(part):
            findings.add((p, i + 1, "ocr"))
            repaired[k] = _NUMBER.sub(lambda m: m[0].translate(_DIGITS), repaired[k])
    return sorted(findings), _reflow(body, repaired, joined, after)


def _reflow(body: list[tuple[int, int, str]], lines: list[str], joined: dict[int, tuple[str, str]], after: dict[int, int]) -> list[str]:
    """Paragraphs: lines joined by spaces; a blank line ends one, unless the text before is cut in a sentence by a page's end."""
    out: list[str] = []
    glue, previous = "", None
    for k, line in enumerate(lines):
        text = " ".join(line.split())
        if not text:
            continue
        new = not out or previous is None or (previous != k - 1 and not (body[previous][0] != body[k][0] and not re.search(r"[.!?。！？…:：”\"]$", out[-1]))) and not glue
        if previous is not None and body[previous][0] != body[k][0] and previous == k - 1 and not glue:
            new = bool(re.search(r"[.!?。！？…”\"]$", out[-1])) and bool(re.match(r"[A-Z0-9“(一-鿿]", text)) and len(out[-1]) < 40
        if glue:
            out[-1] = out[-1] + text
        elif new:
            out.append(text)
        else:
            wide = re.search(r"[⺀-鿿　-〿＀-￯]$", out[-1]) and re.match(r"[⺀-鿿　-〿＀-￯]", text)
            out[-1] = out[-1] + ("" if wide else " ") + text
        glue = ""
        if k in joined:
            out[-1] = out[-1].rstrip(_HYPHENS + " ")
            glue = "joined"
        previous = k
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counter: Counter = Counter()
        for text in batch["text"]:
            text = text.lower()
            counter.update(_TOKEN.findall(text))
            counter.update(_compounds(text))
        yield pd.DataFrame({"word": list(counter), "n": list(counter.values())})


def word_counts(texts: DataFrame, text: Column) -> DataFrame:
    """(word, n) over all texts; what is shuffled is counted per batch."""
    counted = texts.select(text.alias("text")).where("text <> ''").mapInPandas(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[dict[str, int], int, int]:
    """The words frequent enough for the broadcast table (at most ``VOCABULARY``), the least count, and the sum of theirs."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, -(-total // VOCABULARY))
    rows = counts.where(F.col("n") >= least).toPandas()
    return dict(zip(rows["word"], rows["n"].tolist(), strict=True)), least, int(rows["n"].sum())


_HELD: dict[str, object] = {}


def _once(shared, make: Callable[[dict], object]) -> object:
    """What ``make`` makes of a broadcast table, once in each Python worker."""
    key = f"{shared.value['id']} {make.__name__}"
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(shared.value)
    return _HELD[key]


def _trie(value: dict) -> Trie:
    return Trie(value["counts"])


def _told(value: dict) -> Speller:
    return Speller(value["counts"], value["total"], told=True)


def _item(r) -> tuple[list[list[str]], Furniture, bool]:
    """(pages as lines, running lines, whether it is a caption) of a row of papers or captions."""
    running = Furniture(r.stem, r.title, r.venue, r.year)
    if hasattr(r, "caption"):
        running.seen.update(r.seen if r.seen is not None else ())
        return [r.caption.split("\n")], running, True
    return [(t or "").split("\n") for t in r.pages], running, False


def _ask(shared):
    """(key, furniture, words, stem, seen) of each item.

    Furniture is 'page,line,kind', words are those that aren't known to be right, seen the learned running lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                pages, running, caption = _item(r)
                furniture = item_furniture(pages, running, caption)
                rows.append((r.key, [f"{p},{i},{k}" for (p, i), k in furniture.items()], sorted(asked_words(pages, furniture, shared.value["counts"])), r.stem, sorted(running.seen)))
            yield pd.DataFrame(rows, columns=["key", "furniture", "words", "stem", "seen"])

    return run


_FOUND = "word string, general int, edits int, place int, m long, other string"


def _correct(shared):
    """The candidates in the broadcast trie of each row's word, which occurs n times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, edits = _once(shared, _trie), _by_first(CONFUSIONS)
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"].tolist(), strict=True):
                if len(word) > 1:
                    found = trie.search(word, lambda g, e, n=n, word=word: needed(n, word, g, e), edits)
                    rows.extend((word, g, e, p, m, other) for g, e, other, p, m in found)
            yield pd.DataFrame(rows, columns=["word", "general", "edits", "place", "m", "other"])

    return run


#: Words with more letters are joined by their pieces, shorter ones by their readings and shortened forms, of which long words have too many.
LONG = 24
#: Two edits change four letters at most (a merge or split two), so of so many pieces one is left as it was, at most ``EDITS`` letters away.
PIECES = 2 * EDITS + 1


def _pieces(length: int) -> list[tuple[int, int]]:
    return [(i * length // PIECES, (i + 1) * length // PIECES) for i in range(PIECES)]


def word_signs(word: str) -> set[str]:
    """What ``word`` shares with each word it may be a misreading of: 'c' and a reading by confusions, 'g' and a shortened form, 'p' and a piece."""
    signs: set[str] = set()
    if len(word) <= LONG + EDITS:
        signs.update(f"c{v}" for v in variants(word) if v.isalpha())
        if len(word) >= FULL:
            signs.update(f"g{x}" for x in shortened(word, EDITS))
            signs.update(f"g{x}" for v in variants(word, 1) for x in shortened(v, EDITS - 1))
    for length in range(max(LONG + 1, len(word) - EDITS), len(word) + EDITS + 1):
        for i, (start, end) in enumerate(_pieces(length)):
            signs.update(f"p{length} {i} {word[start + d : end + d]}" for d in range(-EDITS, EDITS + 1) if start + d >= 0)
    return signs


def vocabulary_signs(other: str) -> set[str]:
    """The same of a word of the vocabulary."""
    if len(other) > LONG:
        return {f"p{len(other)} {i} {other[start:end]}" for i, (start, end) in enumerate(_pieces(len(other)))}
    return {f"c{other}", *(f"g{x}" for x in shortened(other, EDITS))}


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            part = batch.iloc[start : start + 200]
            yield pd.DataFrame([(w, n, x) for w, n in zip(part["word"], part["n"], strict=True) for x in word_signs(w)], columns=["word", "n", "sign"])


def _printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            part = batch.iloc[start : start + 200]
            yield pd.DataFrame([(w, m, x) for w, m in zip(part["other"], part["m"], strict=True) for x in vocabulary_signs(w)], columns=["other", "m", "sign"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The automaton over one word: whether ``other`` is a candidate for ``word``."""
    edits = _by_first(CONFUSIONS)
    for batch in batches:
        rows = []
        for word, n, other, m in zip(batch["word"], batch["n"].tolist(), batch["other"], batch["m"].tolist(), strict=True):
            found = Trie({other: m}).search(word, lambda g, e, n=n, word=word: needed(n, word, g, e), edits)
            rows.extend((word, g, e, p, m, other) for g, e, _, p, _ in found)
        yield pd.DataFrame(rows, columns=["word", "general", "edits", "place", "m", "other"])


def rare_candidates(words: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(word, general, edits, place, m, other): the candidates of ``words`` (word, n) among the words that occur less than ``least`` times.

    Complete as the walk of the trie is: words within two edits of each other
    share a reading, a shortened form or a piece, by which they are joined, and the automaton decides.
    """
    others = counts.where((F.col("n") >= ANCHOR) & (F.col("n") < least) & F.col("word").rlike(r"^\p{L}+$")).select(F.col("word").alias("other"), F.col("n").alias("m"))
    # An edit changes a word's length by one letter at most, so longer words than this (some have thousands of letters) have no candidate here.
    longest = (others.agg(F.max(F.length("other"))).first()[0] or 0) + EDITS
    able = words.where((F.col("n") * RATIO < least) & F.length("word").between(2, longest))
    signs = able.mapInPandas(_readings, "word string, n long, sign string")
    pairs = signs.join(others.mapInPandas(_printed, "other string, m long, sign string"), "sign").where("m >= n").select("word", "n", "other", "m").distinct()
    return pairs.mapInPandas(_compare, _FOUND)


def _facts(asked: DataFrame, counts: DataFrame, least: int, held: DataFrame, trie) -> DataFrame:
    """(word, fact) of the words in ``asked`` that the collection holds or that have candidates.

    ``held`` are the candidates of the words of the broadcast table.  A fact is the word, n and
    its candidates with tabs between, these as 'general,edits,place,count,word'.
    """
    words = written(asked.select("word").distinct().join(counts, "word", "left").fillna(0, ["n"]))
    rest = words.where(F.col("n") < least)
    found = held.unionByName(rest.mapInPandas(_correct(trie), _FOUND))
    if least > ANCHOR:  # else the broadcast table has all candidates
        found = found.unionByName(rare_candidates(words, counts, least))
    near = found.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(",", "general", "edits", "place", "m", "other"))), "\t").alias("near"))
    return words.join(near, "word", "left").where("n > 0 or near is not null").select("word", F.concat_ws("\t", "word", F.col("n").cast("string"), "near").alias("fact"))


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = _once(shared, _told)
        for batch in batches:
            names = ["stem", "item", "findings", "caption"] if hasattr(batch, "caption") else ["stem", "findings", "paragraphs"]
            for start in range(0, len(batch), 200):
                rows = []
                for r in batch.iloc[start : start + 200].itertuples(index=False):
                    pages, running, caption = _item(r)
                    furniture = {(int(p), int(i)): k for p, i, k in (x.split(",") for x in r.furniture)}
                    speller.take(r.facts)
                    findings, paragraphs = scan_lines(pages, running, speller, caption, furniture)
                    if caption:
                        rows.append((r.stem, r.item, [(n, k) for _, n, k in findings], " ".join(paragraphs)))
                    else:
                        rows.append((r.stem, [(p + 1, n, k) for p, n, k in findings], paragraphs))
                yield pd.DataFrame(rows, columns=names)

    return run


def scan_papers(papers: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, captions) repaired.

    ``papers`` is (stem, title, venue, year, pages array<string>), ``captions``
    (stem, item, caption).  Result: (stem, findings array<struct<page,line,noise>>,
    paragraphs array<string>) and (stem, item, findings array<struct<line,noise>>,
    caption).  Null pages count as empty ones; null and empty captions give no
    row; a caption of an unknown paper is repaired without its running lines, one of
    a paper whose rows differ with the least title, venue and year.
    """
    spark = papers.sparkSession
    texts = papers.select(F.explode("pages").alias("text")).unionByName(captions.select(F.col("caption").alias("text")))
    counts = written(word_counts(texts, F.col("text")))
    held, least, total = vocabulary(counts)
    share = lambda words: spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "counts": words, "total": total})
    trie = share({w: n for w, n in held.items() if n >= ANCHOR and w.isalpha()})
    # The broadcast words that may be misread themselves are asked for like rare ones; the others are known to be right.
    doubtful = written(counts.where(F.col("n") >= least).mapInPandas(_correct(trie), _FOUND))
    # They have no candidate among rarer words, as an original is always more frequent.
    doubted = {r[0] for r in doubtful.select("word").distinct().collect()}
    shared = share({w: n for w, n in held.items() if w not in doubted})
    about = papers.where("stem is not null").groupBy("stem").agg(F.min(F.struct("title", "venue", "year")).alias("m"))
    pages = papers.where(F.size("pages") > 0).select("stem", "title", "venue", "year", "pages")
    # Two 64-bit hashes of the whole row.
    keyed = lambda x: x.withColumn("key", F.concat_ws(" ", F.xxhash64(*x.columns), F.xxhash64(F.lit(1), *x.columns)))
    look = lambda x: written(
        x.mapInPandas(_ask(shared), "key string, furniture array<string>, words array<string>, stem string, seen array<string>").dropDuplicates(["key"])
    )
    pages = keyed(pages)
    looked = [look(pages)]
    learned = looked[0].where("stem is not null").select("stem", F.explode("seen").alias("line")).groupBy("stem").agg(F.array_sort(F.collect_set("line")).alias("seen"))
    joined = captions.where("caption <> ''").join(about, "stem", "left").join(learned, "stem", "left")
    items = [pages, keyed(joined.select("stem", "item", "caption", "m.title", "m.venue", "m.year", "seen"))]
    looked.append(look(items[1]))
    asked = [x.select("key", F.explode("words").alias("word")) for x in looked]
    facts = written(_facts(asked[0].unionByName(asked[1]), counts, least, doubtful, trie))
    full = []
    for x, k, a in zip(items, looked, asked, strict=True):
        told = a.join(facts, "word").groupBy("key").agg(F.collect_set("fact").alias("facts"))
        full.append(x.join(k.select("key", "furniture").join(told, "key", "left").hint("shuffle_hash"), "key"))
    return (
        full[0].mapInPandas(_scan(shared), "stem string, findings array<struct<page int, line int, noise string>>, paragraphs array<string>"),
        full[1].mapInPandas(_scan(shared), "stem string, item int, findings array<struct<line int, noise string>>, caption string"),
    )
