"""Papers of proceedings: a paged source of notes, kinds of pages, links behind links, and the choice among them.

Whatever is fetched goes through a port (``ports.Fetcher``) and is written to the
shared folder before it is read, so each address is asked for once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litlake.functions.text import conference_url
from litlake.operators.match import pattern_provenance
from litlake.ports import Fetcher, fetch_all
from litlake.session import written
from litlake.sources import files

NOTES = "id string, content struct<title:struct<value:string>,venue:struct<value:string>,keywords:struct<value:array<string>>,abstract:struct<value:string>>"
#: Columns of a paper table.
COLUMNS = ["paper_id", "title", "type", "keywords", "abstract", "url"]


def notes_source(fetcher: Fetcher) -> type[DataSource]:
    """A data source ``litlake_notes`` over a notes service: options base, venue and limit (notes of a page).

    The first page tells how many notes there are; each page is a partition.
    """

    class Notes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "litlake_notes"

        def schema(self) -> str:
            return NOTES

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(dict(self.options))

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.limit = int(options.get("limit", 1000))
            invitation = quote(options["venue"] + "/-/Submission", safe="")
            self.address = f"{options.get('base', 'https://api2.openreview.net')}/notes?invitation={invitation}&limit={self.limit}&offset="

        def page(self, offset: int) -> dict:
            return json.loads(fetcher.fetch(f"{self.address}{offset}"))

        def partitions(self) -> list[InputPartition]:
            count = self.page(0).get("count", 0)
            return [InputPartition(offset) for offset in range(0, count, self.limit)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition is None:  # no notes at all
                return
            for note in self.page(partition.value)["notes"]:
                content = note.get("content", {})
                value = lambda name: ((content.get(name) or {}).get("value"),)  # noqa: B023, E731
                yield note["id"], (value("title"), value("venue"), value("keywords"), value("abstract"))

    return Notes


@F.pandas_udf(T.StringType())
def _resolved(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, r) if b is not None and r is not None else None for b, r in zip(base, reference, strict=True)])


def resolve_url(base: Column, reference: Column) -> Column:
    """A reference on the page ``base`` as a whole address; whole addresses don't leave the JVM."""
    whole = reference.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    return F.when(whole, reference).otherwise(_resolved(F.when(~whole, base), F.when(~whole, reference)))


def day_links(pages: DataFrame, days: int = 3) -> DataFrame:
    """(url, link): the first links of a page's list, each to a page of one day, as whole addresses."""
    found = F.slice(F.regexp_extract_all("html", F.lit(r'(?is)<dd>\s*<a[^>]+href="([^"]+)"'), F.lit(1)), 1, days)
    return pages.select("url", F.explode(found).alias("reference")).select("url", resolve_url(F.col("url"), F.col("reference")).alias("link"))


def year_section(pages: DataFrame, year: int) -> DataFrame:
    """(url, html): what stands below the first fold-out button that names the year; pages without one are left out."""
    button = r'<button[^>]*class="[^"]*accordion[^"]*"[^>]*>'
    pattern = rf"(?is){button}[^<]*{year}[^<]*</button>(.*?)(?={button}|\z)"
    return pages.select("url", F.regexp_extract("html", pattern, 1).alias("html")).where("html <> ''")


def list_sections(pages: DataFrame, indexes: list[int] | None = None) -> DataFrame:
    """(url, section, html): the publication lists of a page from 0, all or those with these numbers."""
    parts = F.split("html", r'(?i)<ul[^>]*class="[^"]*publ-list[^"]*"[^>]*>')
    rows = pages.select("url", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).alias("section", "html"))
    return rows if indexes is None else rows.where(F.col("section").isin(*indexes))


def _html(fetched: DataFrame) -> DataFrame:
    return fetched.where("error is null").select("url", F.decode("content", "UTF-8").alias("html"))


def fetch_pages(spark: SparkSession, urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(url, html) of ``urls`` (url); addresses that can't be fetched are left out."""
    return _html(written(fetch_all(urls.select("url", F.col("url").alias("__address")), "url", "__address", fetcher)))


def galley_links(entries: DataFrame, fetcher: Fetcher) -> DataFrame:
    """``entries`` (url, pos, title, link) with ``link`` replaced by that of the PDF on the page it leads to; entries without one are left out."""
    pages = fetch_pages(entries.sparkSession, entries.select(F.col("link").alias("url")).distinct(), fetcher)
    anchor = F.regexp_extract("html", r'(?is)(<a[^>]*class="[^"]*obj_galley_link[^"]*\bpdf\b[^"]*"[^>]*>)', 1)
    found = pages.select(F.col("url").alias("link"), F.regexp_extract(anchor, r'(?is)href="([^"]+)"', 1).alias("reference")).where("reference <> ''")
    pdf = found.select("link", resolve_url(F.col("link"), F.col("reference")).alias("__pdf"))
    return entries.join(pdf, "link").select("url", "pos", "title", F.col("__pdf").alias("link"))


def _open_pages(spark: SparkSession, pages: DataFrame, year: int, fetcher: Fetcher) -> DataFrame:
    return files.page_pairs(pages)


def _day_pages(spark: SparkSession, pages: DataFrame, year: int, fetcher: Fetcher) -> DataFrame:
    if year > 2020:
        return files.page_pairs(pages)
    return files.page_pairs(fetch_pages(spark, day_links(pages).select(F.col("link").alias("url")).distinct(), fetcher))


def _year_pages(spark: SparkSession, pages: DataFrame, year: int, fetcher: Fetcher) -> DataFrame:
    return files.page_pairs(year_section(pages, year))


def _bibliography(spark: SparkSession, pages: DataFrame, year: int, fetcher: Fetcher) -> DataFrame:
    sections = list_sections(pages).select(F.concat("url", F.lit("#"), F.lpad(F.col("section").cast("string"), 6, "0")).alias("url"), "html")
    return galley_links(files.proceedings_entries(sections), fetcher)


#: (url, pos, title, link) of a conference's pages, by its name.
KINDS: dict[str, Callable[[SparkSession, DataFrame, int, Fetcher], DataFrame]] = {
    "CVPR": _day_pages, "ICCV": _open_pages, "ECCV": _year_pages, "AAAI": _bibliography, "ACMMM": _bibliography,
}


def fetch_papers(
    spark: SparkSession, conference: str, year: int, fetcher: Fetcher, source: str = "auto", venue: str | None = None, url: str | None = None, patterns: list[str] | None = None,
    base: str = "https://api2.openreview.net",
) -> DataFrame:
    """The paper table of a conference's year.

    ``source`` is openreview (notes), openaccess (pages) or auto, which the
    conference decides.  For pages the type is the conference and the keywords
    are the ``patterns`` that a title matches.  Unknown conferences are errors.
    """
    name = conference.strip().upper()
    kind = spark.range(1).select(files.resolve_source(F.lit(name), F.lit(source))).first()[0]
    if kind == "openreview":
        spark.dataSource.register(notes_source(fetcher))
        notes = spark.read.format("litlake_notes").option("venue", venue or f"{conference.strip()}.cc/{year}/Conference").option("base", base).load()
        return files.venue_notes(written(notes))
    if kind != "openaccess" or name not in KINDS:
        raise ValueError(f"no source for {conference} ({source})")
    address = url or spark.range(1).select(conference_url(F.lit(name), F.lit(year))).first()[0]
    pages = fetch_pages(spark, spark.createDataFrame([(address,)], "url string"), fetcher)
    papers = files.paper_rows(KINDS[name](spark, pages, year, fetcher), name)
    return papers.withColumn("keywords", pattern_provenance(F.col("title"), patterns)) if patterns else papers
