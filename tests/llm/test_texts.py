"""Splitting, packing, mixing, sentences and scans."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litlake.llm import mixing, packing, scans, sentences, splitting, tokens


# ---- splitting ----------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n。é́", max_size=900), st.integers(20, 90), st.integers(0, 19))
def test_split_round_trip(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    assert "".join(text[s if n == 0 else s + overlap : e] for n, (s, e, _) in enumerate(pieces)) == text
    assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:], strict=False))


def test_split_prefers_strong_boundaries():
    text = ("Word word word. " * 20 + "\n\n") * 10
    kinds = [k for _, _, k in splitting.split_text(text, 1100, 50)]
    assert set(kinds[:-1]) == {"paragraph"}
    assert {k for _, _, k in splitting.split_text("x" * 500, 100, 10)[:-1]} == {"char"}
    assert {k for _, _, k in splitting.split_text("word " * 200, 100, 10)[:-1]} == {"word"}
    with pytest.raises(ValueError):
        splitting.split_text("a", 5, 5)


def test_split_at_sentences_not_at_abbreviations():
    text = "It was shown by Smith et al. (see Fig. 3 and Eq. 4) that it holds. " * 40
    cuts = [e for limit in (300, 350, 420) for _, e, k in splitting.split_text(text, limit, 20) if k == "sentence"]
    assert len(cuts) > 10 and all(text[:e].endswith("holds. ") for e in cuts)


def test_split_adds_pieces_while_a_boundary_exists():
    text = ("x" * 52 + " ") * 40  # a piece of 100 holds one word only
    kinds = [k for _, _, k in splitting.split_text(text, 100, 0)[:-1]]
    assert set(kinds) == {"word"} and len(kinds) + 1 > len(text) / 100 + 4


def test_split_balances():
    sizes = [e - s for s, e, _ in splitting.split_text("word " * 1000, 2000, 100)]
    assert max(sizes) - min(sizes) < 60


def test_paragraphs():
    text = "\n  \n a\nb\n \nc\n\n"
    assert [text[s:e] for s, e in splitting.paragraphs(text)] == [" a\nb", "c"]
    assert splitting.paragraphs("") == [] and splitting.paragraphs(" \n") == []


def test_split_operator(spark):
    long = "p" * 150
    rows = [("a", f"x\n\n{long}\n\ny", 100, 10, "c"), ("b", "short", 100, 10, "c"), ("c", None, 100, 10, None), ("d", "z " * 200_000, 100, 10, "c"), ("a", f"x\n\n{long}\n\ny", 100, 10, "c")]
    df = spark.createDataFrame(rows, "k string, text string, max_size long, overlap long, cut string")
    out = splitting.split_oversized(df, ["k"]).cache()
    assert out.where("length(piece) > 100").count() == 0
    assert {(r["k"], r["para_no"], r["para_chars"]) for r in out.where("k = 'a' and para_no is not null").collect()} == {("a", 2, 150)}
    assert {r["k"] for r in out.select("k").distinct().collect()} == {"a", "d"}
    assert splitting.split_oversized(df.limit(0), ["k"]).count() == 0


# ---- packing and mixing ---------------------------------------------------------------------------------


def best_gap(open_gaps, size, capacity):
    """Sum-of-squares choice by definition."""

    def cost(gaps):
        return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < capacity)

    options = [(cost(open_gaps + [capacity - size]), capacity + 1)]
    for g in set(open_gaps):
        if g >= size:
            left = list(open_gaps)
            left.remove(g)
            options.append((cost(left + [g - size]), g))
    return min(options)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40))
def test_packer_takes_the_least_sum_of_squares(sizes):
    packer, gaps = packing.Packer(12), {}
    for size in sizes:
        least = best_gap([g for g in gaps.values() if g], size, 12)
        box = packer.place(size)
        gaps[box] = gaps.get(box, 12) - size
        assert gaps[box] >= 0
        now = [g for g in gaps.values() if 0 < g < 12]
        assert sum(now.count(g) ** 2 for g in set(now)) == least


def test_packing_operator(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, rng.randint(1, 80), 777])) for i in range(2000)]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc long, size long, tokens string")
    placed = packing.fill_containers(df, "doc", 200, shard_tokens=50_000).cache()
    assert {r["doc"]: r["s"] for r in placed.groupBy("doc").agg(F.sum("tokens").alias("s")).collect()} == {i: s for i, s in rows if s}
    fill = packing.container_fill(placed, 200)
    worst, unused, n = fill.agg(F.max("tokens"), F.sum("unused"), F.count("*")).first()
    assert worst <= 200 and unused <= 0.03 * 200 * n
    small = {i for i, s in rows if s and s <= 200}
    assert {r["doc"] for r in placed.groupBy("doc").count().where("count > 1").collect()}.isdisjoint(small)
    assert packing.fill_containers(df.limit(0), "doc", 200).count() == 0


def test_water_fill():
    out = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 10, "b": 1000, "c": 1000}, 110)
    assert out == pytest.approx({"a": 10, "b": 60, "c": 40, "d": 0})
    assert mixing.water_fill({"a": 1.0}, {"a": 5}, 50) == {"a": 5}
    assert mixing.water_fill({}, {}, 5) == {}


def test_mixing_operator(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "unlisted"]), f"t{i % 900}", 1 + i % 37) for i in range(3000)]
    rows = [(i, s, t, 1 + int(t[1:]) % 37) for i, s, t, _ in rows] + [(9001, "b", None, None), (9002, "a", "t9", 0)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, text_key string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 4), ("c", 0.4, 2), ("d", 0.1, 3)], "source string, target_share double, max_repeats int")
    draws, shares = mixing.mix_sources(texts, targets, total_tokens=12_000)
    most = {"a": 1, "b": 4, "c": 2}
    drawn = draws.join(texts, ["doc_id", "source"]).collect()
    assert all(r["repeats"] <= most[r["source"]] for r in drawn)
    assert len({r["text_key"] for r in drawn}) == len(drawn)
    by = {r["source"]: r for r in shares.collect()}
    assert by["d"]["drawn_tokens"] == 0 and sum(r["share_reached"] for r in by.values()) == pytest.approx(1)
    wanted = mixing.water_fill({"a": 0.2, "b": 0.3, "c": 0.4, "d": 0.1}, {s: by[s]["available_tokens"] * by[s]["max_repeats"] for s in by}, 12_000)
    for s, r in by.items():
        assert abs(r["drawn_tokens"] - wanted[s]) <= 40
    again = mixing.mix_sources(texts.orderBy(F.rand()), targets, total_tokens=12_000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, draws.collect()))
    assert mixing.mix_sources(texts.limit(0), targets)[0].count() == 0
    assert mixing.mix_sources(texts, targets.limit(0))[1].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [2, 0, None]


# ---- sentences ------------------------------------------------------------------------------------------

UNITS = [
    ["Dr. A. Smith et al. (2018) met N. Lee, Ph.D., at 5 p.m.", "Then they left."],
    ["We compared x, y, etc.", "See Fig. 3 and (cf. Sec. 4.6) it.", "It cost 3.5 points vs. 2.", "Really?!", "Yes…"],
    ["“Is it?” asked the second.", "He said “it is.”", "One shouted “Stop!” and left.", "(See App. B for it.)", "The end (why?) came."],
    ["It rose... and then fell.", "It was mild. . . or so they say.", "tool 3.4 loads it.", "61 raters came."],
    ["Die Sitzung am 3. Mai dauerte z. B. 5 Minuten, d. h. kurz.", "„Bleibt sie?“, fragte er.", "Er nannte es „die Stimme.“", "Keine blieb …", "Am 3. Mai kam er."],
    ["« La pause est nette ! » a dit Mme Xu.", "Le Dr Xu note p. ex. ceci.", "Voir chap. 3, p. 5.", "« Oui. »", "Rien…"],
    ["«¿Es clara?», dijo la Dra. Y.", "¡Qué voz!", "No hubo voz...", "Véanse las págs. 3-4."],
]
CJK = [
    ["“为什么是序列？”一位听众反复问。", "评审问道：“真的吗？”", "（详见附录。）", "没有人注意到……", "第4.3节讨论情绪；第9节讨论语音。"],
    ["「評価は静かだ。」と述べた。", "視線（連続的なもの。）は除いた。", "これは何か？！"],
]


@pytest.mark.parametrize("units", UNITS)
@pytest.mark.parametrize("glue", [" ", "\n", "\n\n", "  \t"])
def test_spaced_scripts(units, glue):
    text = glue.join(units)
    ends, place = [], 0
    for u in units:
        place = text.index(u, place) + len(u)
        ends.append(place)
    assert sentences.sentence_ends(text) == ends


@pytest.mark.parametrize("units", CJK)
def test_scripts_without_spaces(units):
    text = "".join(units)
    assert sentences.sentence_ends(text) == [len("".join(units[: i + 1])) for i in range(len(units))]


def test_structure():
    def units(text):
        out, start = [], 0
        for e in sentences.sentence_ends(text):
            out.append(text[start:e].strip())
            start = e
        return out

    assert units("## Results\n\n1. Intro\n\nOne.Two here.\n\n- a. B c\n- d\n\n1) x. Y\n2) z\n") == ["## Results", "1. Intro", "One.", "Two here.", "- a. B c", "- d", "1) x. Y", "2) z"]
    assert units("ระบบ A ใช้ 3.5 มาก เราเก็บเสียง ใครมา?") == ["ระบบ A ใช้ 3.5 มาก", "เราเก็บเสียง", "ใครมา?"]
    assert units("डॉ. Ab ने देखा। “क्या है?” उसने पूछा।") == ["डॉ. Ab ने देखा।", "“क्या है?” उसने पूछा।"]
    assert units(" \n\t") == [] and units("x") == ["x"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["Word ", "word ", "etc. ", "Dr. ", "3.5 ", "“", "” ", "(", ") ", ".", "? ", "…", "\n", "\n\n", "- ", "1) ", "情感", "。", "「", "」", "ก", " ", "plain words here, "]), max_size=120))
def test_chunks_compose(parts):
    text, old = "".join(parts), sentences.SEARCH
    whole = sentences.sentence_ends(text)
    try:
        sentences.SEARCH = 40
        assert sentences.sentence_ends(text, 30) == whole
    finally:
        sentences.SEARCH = old


def test_sentence_operator(spark):
    long = "Plain words go on here. " * 9000 + "\n\n情感很好。" * 3000
    rows = [(1, "Ab cd. Ef gh."), (1, "Ab cd. Ef gh."), (2, None), (3, ""), (4, " \n"), (5, long), (1, "Other. Text.")]
    df = spark.createDataFrame([(k, x, "e") for k, x in rows], "doc long, text string, sent_end string")
    out = sentences.sentences(df, "doc")
    got = sorted(map(tuple, out.collect()))
    assert [e for k, e in got if k == 5] == sentences.sentence_ends(long) and len([1 for k, _ in got if k == 5]) == 12_000
    assert [x for x in got if x[0] != 5] == [(1, 6), (1, 6), (1, 12), (1, 13)]
    assert sentences.sentences(df.limit(0), "doc").count() == 0


def test_long_text_over_several_tasks(spark):
    parts = ["Plain words go on (here. Really) and there. ", "He said “no. Never.” and left. ", "一句话。又一句话。", "\n\n", "- item one. x\n", "About 3.5 of them, e.g. Dr. B. Smith, came. "]
    rng = random.Random(6)
    long = "".join(rng.choice(parts) for _ in range(400_000))  # some 10 MB in some 600 chunks: three levels
    assert len(long.encode()) > 10_000_000
    df = spark.createDataFrame([(None, long), (2, "Ab cd. Ef gh.")], "doc long, text string")
    out = sentences.sentences(df, "doc", distinct=False)
    got = out.collect()
    assert sorted(r["sent_end"] for r in got if r["doc"] is None) == sentences.run_from(long, 0)[1]
    assert sorted(r["sent_end"] for r in got if r["doc"] == 2) == [6, 13]


def test_prefix_scan(spark, monkeypatch):
    monkeypatch.setattr(sentences, "FAN", 3)
    rng = random.Random(7)
    rows, want = [], {}
    for tag, n in (("a", 1), ("b", 3), ("c", 27), ("d", 20)):
        state = 0
        for i in range(n):
            f = [rng.randrange(4) for _ in range(1 if i == 0 else 4)]
            rows.append((tag, i, f))
            want[tag, i] = state
            state = f[state]
    df = spark.createDataFrame(rows + rows[:5], "tag string, chunk int, following array<int>")
    assert {(r["tag"], r["chunk"]): r["start"] for r in sentences.prefix_scan(df).collect()} == want


@pytest.mark.parametrize(
    "text,units",
    [
        ("This is (a test. Next one. Another one here. Last.", 2),
        ('A "stray mark here. It goes on. And on. And on. And on.', 3),
        ("He (that is [the {inner. Part} of] it. All) came. Then he left.", 2),
    ],
)
def test_marks_that_never_close(text, units):
    assert len(sentences.sentence_ends(text)) == units


# ---- scans ----------------------------------------------------------------------------------------------


def speller():
    words = "clear modern picture models distant running during the of and in results signal translation listeners audio visual dense number"
    return scans.Speller({w: 400 for w in words.split()} | {"audio-visual": 60, "one": 50})


@pytest.mark.parametrize(
    "read,printed",
    [("c1ear", "clear"), ("modem", "modern"), ("rnodels", "models"), ("pictiire", "picture"), ("clistant", "distant"), ("5ignal", "signal"), ("transla|ion", "translation"), ("rurining", "running"), ("rcsu1ts", "results"), ("sgnal", "signal"), ("modxern", "modern"), ("listneers", "listeners"), ("clear", None), ("zzzz", None), ("o", None)],
)
def test_speller(read, printed):
    assert speller().original(read) == printed


def brute_readings(word):
    """{text: (edits that are no confusions, edits)} for all that may have been printed, over the letters of the test."""
    letters = "clmnriudhb"
    best, front = {}, {("", word, 0, 0)}
    while front:
        following = set()
        for done, rest, general, used in front:
            if not rest and used and (general, used) < best.get(done, (9, 9)):
                best[done] = general, used
            if rest:
                following.add((done + rest[0], rest[1:], general, used))
            if used < scans.EDITS:
                for read, printed in scans.CONFUSIONS:
                    if rest.startswith(read):
                        following.add((done + printed, rest[len(read) :], general, used + 1))
                if rest:
                    following.add((done, rest[1:], general + 1, used + 1))
                for x in letters:
                    following.add((done + x, rest, general + 1, used + 1))
                    if rest and x != rest[0]:
                        following.add((done + x, rest[1:], general + 1, used + 1))
        front = following
    return best


@settings(max_examples=40, deadline=None)
@given(st.text("clmnriudhb015", min_size=2, max_size=7), st.lists(st.text("clmnriudhb", min_size=2, max_size=7), min_size=1, max_size=30), st.data())
def test_candidates_are_complete(word, words, data):
    for _ in range(5):  # some words within reach
        near, place = word, data.draw(st.integers(0, len(word)))
        words.append((near[:place] + data.draw(st.text("clmnriudhb", max_size=2)) + near[place + data.draw(st.integers(0, 2)) :]) or "c")
    counts = {w: 100 for w in words if w.isalpha()}
    found = scans.Trie(counts).search(word, lambda g, e: 0, scans._by_first(scans.CONFUSIONS))
    readings = brute_readings(word)
    assert {w: (g, e) for g, e, w, _, _ in found} == {w: readings[w] for w in counts if w in readings}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=1, max_size=8), st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=40))
def test_all_words_within_two_edits(word, words):
    found = scans.Trie({w: 100 for w in words}).search(word, lambda g, e: 0, {})
    assert {w for _, _, w, _, _ in found} | {word} == {w for w in words if distance(word, w) <= 2} | {word}


def test_pruned_walk_finds_what_is_frequent_enough():
    rng = random.Random(3)
    counts = {"".join(rng.choices("abcde", k=rng.randint(2, 8))): rng.choice([12, 30, 5000, 90_000]) for _ in range(3000)}
    trie, edits = scans.Trie(counts), scans._by_first(scans.CONFUSIONS)
    for word in rng.sample(sorted(counts), 60) + ["abc", "abcdeabc"]:
        for n in (0, 1, 40):
            need = lambda g, e: scans.needed(n, word, g, e)  # noqa: B023, E731
            every = trie.search(word, lambda g, e: 0, edits)
            assert {x[2] for x in trie.search(word, need, edits)} == {w for g, e, w, _, m in every if m >= need(g, e)}


@pytest.mark.parametrize("read", "resnlts emotiou netwark sgnal netwrok emoton".split())
def test_any_edit_is_repaired(read):
    words = "results emotion network signal clear modern translation speech".split()
    assert scans.Speller({w: 400 for w in words}).original(read) in words


def test_other_edits_need_a_much_more_frequent_original():
    counts = {"signal": 5000, "signals": 3, "signel": 2, "models": 900}
    s = scans.Speller(counts)
    assert [s.original(w) for w in ("signals", "signel", "siqnal")] == [None, "signal", "signal"]
    assert scans.Speller({**counts, "signal": 3999}).original("signel") is None


def test_rare_candidates_by_join(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choices("abfrntm", k=rng.randint(2, 7))): rng.choice([1, 12, 40, 9000, 30_000]) for _ in range(300)}
    long = "".join(rng.choices("abfrntm", k=27))
    counts |= {"picture": 9000, "w" * 3000: 15, long: 9000, long[:25]: 9000, long[1:25]: 9000}
    words = [("pictume", 1), ("picfure", 2), ("pictiire", 0), ("x" * 5000, 1), ("w" * 2999, 0), (long[:9] + long[10:20] + "q" + long[20:], 0), (long[:12] + long[13:25], 1), (long[:24], 0), ("x" + long, 2), *[(w, n) for w, n in counts.items() if n < 40]]
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in scans.rare_candidates(spark.createDataFrame(words, "word string, n long"), df, 10_000).collect()}
    trie = scans.Trie({w: n for w, n in counts.items() if 12 <= n < 10_000})
    want = {(w, g, e, p, m, o) for w, n in words for g, e, o, p, m in trie.search(w, lambda g, e: scans.needed(n, w, g, e), scans._by_first(scans.CONFUSIONS))}  # noqa: B023
    assert got == want and ("pictume", 1, 1, 5, 9000, "picture") in got


def test_scan_of_pages():
    pages = [
        ["VENUE 2024 · A Long Title of the Pap", "", "The results of the c1ear signal and trans-", "VENUE 2024", "1"],
        ["2 VENUE 2024", "lation of the dense audio-", "visual number. The lis¬", "teners.", "", "O.5 of the number", "2"],
        [""],
        ["A L0ng Title of the Paper", "", "during the", "running results", "4"],
    ]
    found, paragraphs = scans.scan_lines(pages, scans.Furniture("s", "A Long  Title of the Paper on Noise", "VENUE", "2024"), speller())
    assert found == [
        (0, 1, "header"), (0, 3, "hyphen"), (0, 3, "ocr"), (0, 4, "header"), (0, 5, "page_number"),
        (1, 1, "header"), (1, 3, "hyphen"), (1, 6, "ocr"), (1, 7, "page_number"),
        (3, 1, "header"), (3, 5, "page_number"),
    ]
    assert "the clear signal and translation of the dense audio-visual number." in " ".join(paragraphs).replace("audio- visual", "audio-visual")
    assert any("listeners." in p for p in paragraphs) and any("0.5 of the number" in p for p in paragraphs)


def test_page_numbers():
    good = {"- 12 -": 12, "— 7": 7, "p. 3": 3, "[4]": 4, "Page 5 of 9": 5, "6/9": 6, "xiv": 14, "1O": 10}
    assert {k: scans.page_number(k) for k in good} == good
    assert [scans.page_number(x) for x in ("", "a", "0.27", "3 Method", "iiii", "12 of the words")] == [None] * 6


def test_scan_operator(spark):
    words = "the clear signal of the modern picture was running in the results during the distant number and models. "
    page = "\n".join([words.strip()] * 12)
    papers = [("s", "T", "V", "2024", [page, None, "", "the c1ear signal of the results\nand the modern pic-\nture."], "x"), ("s", "T", "V", "2024", [page], "x"), (None, None, None, None, None, "x"), ("u", None, None, None, [], None)]
    df = spark.createDataFrame(papers, "stem string, title string, venue string, year string, pages array<string>, findings string")
    captions = spark.createDataFrame([("s", 1, "Fig. 1: the rnodern\npicture of the results", "q"), ("none", 2, "the resul-\nts of the signal and models\n3", "q"), ("s", 3, None, None), ("s", 4, "", None)], "stem string, item int, caption string, noise string")
    pages, fixed = scans.scan_papers(df, captions)
    rows = {tuple(f) for r in pages.where("stem = 's'").collect() for f in r["findings"]}
    assert rows == {(4, 1, "ocr"), (4, 2, "hyphen")}
    out = {r["item"]: (r["caption"], sorted(tuple(f) for f in r["findings"])) for r in fixed.collect()}
    assert out == {
        1: ("Fig. 1: the modern picture of the results", [(1, "ocr")]),
        2: ("the results of the signal and models", [(1, "hyphen"), (3, "page_number")]),
    }
    empty = scans.scan_papers(df.limit(0), captions.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


@pytest.mark.parametrize("bound", [scans.VOCABULARY, 10])
def test_counts_below_the_broadcast_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(scans, "VOCABULARY", bound)
    common = "the of and in results"
    long = "nl" * 6000  # its readings alone would fill the memory
    pages = [long + "\n" + "\n".join([common] * 60), "\n".join(["models clear"] * 20), "the rnodels of\nthe c1ear re-\nsults and mod-\nels in", "audio-visual of\naudio-visual in\nthe audio-\nvisual of"]
    papers = spark.createDataFrame([("s", None, None, None, pages)], "stem string, title string, venue string, year string, pages array<string>")
    captions = spark.createDataFrame([("s", 1, "the rnodels of the results")], "stem string, item int, caption string")
    found, fixed = scans.scan_papers(papers, captions)
    assert [tuple(f) for f in found.first()["findings"]] == [(3, 1, "ocr"), (3, 2, "hyphen"), (3, 2, "ocr"), (3, 3, "hyphen")]
    assert fixed.first()["caption"] == "the models of the results"


def test_f_and_t_are_taken_for_each_other():
    s = scans.Speller({"figure": 400, "distant": 400})
    assert [s.original(w) for w in ("tigure", "disfant", "dis7ant")] == ["figure", "distant", "distant"]
    assert [x[:2] for w in ("tigure", "dis7ant") for x in s.candidates(w)] == [(0, 1), (1, 1)]


def test_context_is_the_whole_paper():
    s = scans.Speller({"cat": 100_000, "eat": 90_000, "the": 90_000})
    lines = ["the"] * 450 + ["the eat", "the 6at", "the eat"]
    s.edits["6"] += [("6", "c"), ("6", "e")]
    assert s.original("6at") == "cat"
    assert scans.scan_lines([lines], None, s)[1][0].endswith("the eat the eat the eat")


def test_learned_running_lines_in_captions(spark):
    pages = [f"Annual letters of the society\nplain words number {i} go on here\n{i + 1}" for i in range(6)]
    papers = spark.createDataFrame([("s", "A Title Of Its Own", None, None, pages), ("t", "Another", None, None, ["x"])], "stem string, title string, venue string, year string, pages array<string>")
    rows = [(stem, 1, "Fig. 1: words\nAnnual letters of the society\ngo on") for stem in ("s", "t")]
    _, fixed = scans.scan_papers(papers, spark.createDataFrame(rows, "stem string, item int, caption string"))
    assert {r["stem"]: [tuple(f) for f in r["findings"]] for r in fixed.collect()} == {"s": [(2, "header")], "t": []}
