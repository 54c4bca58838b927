"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm import mixing, neardup, packing, scans, sentences, setjoin, splitting, sql, termcounts, tokens
from litlake.llm.classes import connected_groups, expand_pairs, first_rows
from litlake.operators.packed import split_packed
from litlake.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, page_no, text, max_size, overlap): full texts as page 0, then the pages."""
    papers = table(spark, sf_dir, "parsed_papers")
    limits = F.broadcast(  # three rows, whatever the scale
        table(spark, sf_dir, "size_limits").where("unit = 'chars'").select("item", "max_size", "overlap")
    )
    whole = papers.select("stem", F.lit(0).alias("page_no"), F.lit("full_text").alias("item"), F.col("full_text").alias("text"))
    pages = papers.select("stem", F.posexplode("page_texts").alias("n", "text"))
    pages = pages.select("stem", (F.col("n") + 1).alias("page_no"), F.lit("page_texts").alias("item"), "text")
    return whole.unionByName(pages).join(limits, "item").select("stem", "page_no", "text", "max_size", "overlap")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over their limit (para_no 0) and, in them, paragraphs over it.

    A paragraph over the limit can't lie within one piece, so some cut of the
    splitter goes through it; its length is then checked exactly.
    """
    pieces = splitting.split_oversized(_items(spark, sf_dir).withColumn("size", F.col("max_size")), ["stem", "page_no", "size"], with_text=False)
    found = pieces.select(
        "stem",
        "page_no",
        F.explode(F.array_distinct(F.array(F.lit(0), F.when(F.col("para_chars") > F.col("size"), F.col("para_no")).otherwise(0)))).alias("para_no"),
    )
    return found.distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item over its limit; papers parsed twice give theirs once."""
    return splitting.split_oversized(_items(spark, sf_dir), ["stem", "page_no"]).dropDuplicates(["stem", "page_no", "piece_no"])


def p1_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item over its limit put together again from its pieces without their overlaps: its length and digest, and whether all pieces keep to limit and overlap."""
    items = _items(spark, sf_dir).withColumn("limit", F.col("max_size")).withColumn("repeated", F.col("overlap"))
    pieces = splitting.split_oversized(items, ["stem", "page_no", "limit", "repeated"]).dropDuplicates(["stem", "page_no", "piece_no"])
    new = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", F.col("repeated").cast("int") + 1, F.length("piece")))
    rows = pieces.groupBy("stem", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))), lambda x: x["new"]), "").alias("whole"),
        F.bool_and((F.length("piece") <= F.col("limit")) & (F.length("piece") == F.col("end") - F.col("start"))).alias("kept"),
        (F.count("*") == F.max("pieces")).alias("complete"),
    )
    return rows.select("stem", "page_no", F.length("whole").alias("chars"), F.md5("whole").alias("digest"), "kept", "complete")


def _keyword_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = first_rows(table(spark, sf_dir, "all_papers"), "paper_id", "pos", ["keywords"])
    return papers.select("paper_id", split_packed(F.col("keywords")).alias("items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of papers with at least 3 keywords each and a similarity of 0.6 or more."""
    members, links = setjoin.similar_sets(_keyword_sets(spark, sf_dir), "paper_id", "items", 0.6, 3)
    return expand_pairs(members, links.select("cls_a", "cls_b"), "paper_id")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper with at least 3 keywords: its class of equal sets, named by the lowest paper, the class's size and its number of similar classes."""
    members, links = setjoin.similar_sets(_keyword_sets(spark, sf_dir), "paper_id", "items", 0.6, 3)
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("class_size"), F.min("paper_id").alias("class"))
    return members.join(sizes, "cls").join(ends, "cls", "left").fillna(0, ["links"]).drop("cls")


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    papers = table(spark, sf_dir, "all_papers")
    total = papers.select("paper_id").where("paper_id is not null").distinct().count()
    once = first_rows(papers, "paper_id", "pos", ["keywords", "title"])
    both = once.select(
        F.col("paper_id").alias("record"),
        F.explode(
            F.array(
                F.struct(F.lit("keywords").alias("field"), split_packed(F.col("keywords")).alias("terms")),
                F.struct(F.lit("title").alias("field"), termcounts.words_of("title").alias("terms")),
            )
        ).alias("x"),
    )
    counts = termcounts.term_counts(both.select("record", "x.field", "x.terms"), partitioned=True)
    return counts, total


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of keywords and titles with its occurrences, papers and mark."""
    return termcounts.mark_terms(*_terms(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked terms."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def _scanned(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """``whole``: the full text of a paper without pages stands for its only page."""
    pages = F.col("page_texts")
    if whole:
        pages = F.when(F.size(pages) > 0, pages).when(F.col("full_text") != "", F.array("full_text"))
    papers = table(spark, sf_dir, "parsed_papers").select("stem", "title", "venue", "year", pages.alias("pages"))
    captions = table(spark, sf_dir, "visual_items").select(F.col("source_stem").alias("stem"), F.col("item_index").alias("item"), "caption")
    return scans.scan_papers(papers, captions)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise in each line of pages and captions."""
    pages, captions = _scanned(spark, sf_dir)
    a = pages.select("stem", F.explode("findings").alias("f")).select(
        F.lit("page_texts").alias("field"), "stem", F.col("f.page").alias("item_no"), F.col("f.line").alias("line_no"), "f.noise"
    )
    b = captions.select("stem", "item", F.explode("findings").alias("f")).select(
        F.lit("caption").alias("field"), "stem", F.col("item").alias("item_no"), F.col("f.line").alias("line_no"), "f.noise"
    )
    return a.unionByName(b).distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running paragraphs of each paper, from its pages or else its full text; papers parsed twice give theirs once."""
    pages, _ = _scanned(spark, sf_dir, whole=True)
    return pages.select("stem", F.posexplode("paragraphs").alias("n", "paragraph")).select("stem", (F.col("n") + 1).alias("para_no"), "paragraph").distinct()


def p5_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole captions."""
    _, captions = _scanned(spark, sf_dir)
    return captions.select("stem", F.col("item").alias("item_no"), "caption").distinct()


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers")
    text = F.when((F.col("title") != "") & (F.col("abstract") != ""), F.concat_ws(" ", "title", "abstract"))
    return papers.select(F.col("paper_id").alias("key"), F.col("pos").alias("place"), text.alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of papers whose title and abstract share at least 0.7 of their words."""
    members, links = neardup.near_duplicates(_abstracts(spark, sf_dir), 0.7)
    return expand_pairs(members.withColumnRenamed("key", "paper_id"), links.select("cls_a", "cls_b"), "paper_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper with title and abstract: its class of equal word sets and its group of near-duplicates, each named by its lowest paper."""
    members, links = neardup.near_duplicates(_abstracts(spark, sf_dir), 0.7)
    firsts = members.groupBy("cls").agg(F.min("key").alias("first"))
    a = links.join(firsts.select(F.col("cls").alias("cls_a"), F.col("first").alias("a")), "cls_a")
    edges = a.join(firsts.select(F.col("cls").alias("cls_b"), F.col("first").alias("b")), "cls_b").select("a", "b")
    groups = connected_groups(firsts.select(F.col("first").alias("node")), edges)
    return members.join(firsts, "cls").join(groups, F.col("first") == F.col("node")).select(F.col("key").alias("paper_id"), F.col("first").alias("class"), "grp")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between classes of equal word sets, named as in ``p6_groups``, with their similarity: with the members there all pairs, unexpanded."""
    members, links = neardup.near_duplicates(_abstracts(spark, sf_dir), 0.7)
    firsts = members.groupBy("cls").agg(F.min("key").alias("first"))
    a = links.join(firsts.select(F.col("cls").alias("cls_a"), F.col("first").alias("x")), "cls_a")
    both = a.join(firsts.select(F.col("cls").alias("cls_b"), F.col("first").alias("y")), "cls_b")
    return both.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "size_limits").where("item = 'container'").first()["max_size"]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or each part of one larger than a container, is put."""
    tokens.ship(spark)
    documents = table(spark, sf_dir, "documents").where("text <> ''")
    sizes = documents.select("doc_id", tokens.token_count(F.col("text")).alias("size"))
    return packing.fill_containers(sizes, "doc_id", _capacity(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each container is."""
    return packing.container_fill(p7_containers(spark, sf_dir), _capacity(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens.ship(spark)
    documents = table(spark, sf_dir, "documents").where("text <> '' and source is not null")
    texts = documents.select("doc_id", "source", F.sha1("text").alias("text_key"), tokens.token_count(F.col("text")).alias("n_tokens"))
    return mixing.mix_sources(texts, table(spark, sf_dir, "source_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts drawn and how often."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources reach."""
    return _mixture(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence unit of every document."""
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", distinct=False)  # doc_id is unique


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_round_trip, p3_found, p3_links, p4_found, p4_terms, p5_found, p5_paragraphs, p5_captions, p6_found, p6_groups, p6_links, p7_containers, p7_fill, p8_mix, p8_shares, p9_found)
}
ORACLES: dict[str, str] = sql.ORACLES
