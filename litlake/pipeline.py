"""The stages from notes to reports as one chain of DataFrames, and a command line over tables on disk."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake import ports
from litlake.functions import text as t
from litlake.operators import match, reports, sections, tables
from litlake.session import written
from litlake.sources import files, proceedings, sinks


def fetch_stage(spark: SparkSession, conference: str, year: int, fetcher: ports.Fetcher, **options: object) -> DataFrame:
    """The paper table of a conference's year; see ``proceedings.fetch_papers``."""
    return proceedings.fetch_papers(spark, conference, year, fetcher, **options)


def filter_stage(papers: DataFrame, keywords: list[str], **options: object) -> DataFrame:
    """Matching papers with status columns."""
    return tables.ensure_columns(match.filter_papers(papers, keywords, **options))


def download_stage(papers: DataFrame, conference: str, year: int, fetcher: ports.Fetcher) -> tuple[DataFrame, DataFrame]:
    """(papers with their expected file and status, contents (file, content, error)); papers without an address are missing.

    Papers of one file name are fetched once, here: what was fetched is written
    to the shared folder, and both results read it from there.
    """
    named = papers.withColumn("__file", t.pdf_name(F.lit(year), F.lit(conference), F.coalesce("title", F.lit("nan"))))
    wanted = named.where(~t.is_blank(F.col("url"))).groupBy(F.col("__file").alias("file")).agg(F.min(t.pdf_url(F.col("url"))).alias("url"))
    contents = written(ports.fetch_all(wanted, "file", "url", fetcher))
    there = contents.where("error is null").select(F.col("file").alias("path"))
    return tables.reconcile_files(named, F.col("__file"), there).drop("__file"), contents


def summary_stage(parsed: DataFrame, port: ports.Completer, done: DataFrame | None = None, size: int = 12_000) -> DataFrame:
    """(stem, summary, status, error) of parsed papers (stem, full_text) that are not in ``done``; failures get a report without a model."""
    todo = parsed.where("full_text <> ''").groupBy("stem").agg(F.min("full_text").alias("full_text"))
    if done is not None:
        todo = tables.without_artefacts(todo, done, "stem")
    answers = ports.summarize(todo, "stem", "full_text", port, size).select("stem", F.col("summary").alias("__summary"), F.col("error").alias("__error"))
    joined = todo.join(answers, "stem")
    ok = F.col("__error").isNull()
    fallback = sections.fallback_report(F.col("stem"), F.col("full_text"), F.col("__error"))
    return joined.select(
        "stem", F.when(ok, F.col("__summary")).otherwise(fallback).alias("summary"), F.when(ok, "ok").otherwise("fallback").alias("status"), F.col("__error").alias("error")
    )


def report_stage(papers: DataFrame, parsed: DataFrame, summaries: DataFrame, order: str = "pos") -> DataFrame:
    """Report records of summarised papers; the introduction is Chinese if the summary is."""
    rows = papers.where(~t.is_blank(F.col("pdf_path"))).withColumn("__file", t.base_name(F.col("pdf_path")))
    first = tables.keep_first(rows.select("__file", order, "paper_id", "title", "keywords", "matched_keywords", "abstract"), ["__file"], order)
    texts = parsed.groupBy("stem").agg(F.min(F.struct("pdf_path", "full_text", "venue", "year")).alias("p")).select("stem", "p.*")
    joined = texts.join(summaries.select("stem"), "stem").join(first, t.base_name(texts["pdf_path"]) == first["__file"], "left")
    return reports.report_metadata(joined.drop("__file", order))


def run_stages(
    spark: SparkSession, conference: str, year: int, keywords: list[str], fetcher: ports.Fetcher, parse: Callable[[DataFrame], DataFrame], completer: ports.Completer,
    size: int = 12_000, **options: object,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status table, summaries, reports) of all stages: fetch, filter, download, parse, summarise.

    ``parse`` makes parsed papers (stem, pdf_path, full_text, venue, year) of contents (file, content, error).
    """
    papers = fetch_stage(spark, conference, year, fetcher, **options).withColumn("pos", F.col("paper_id"))
    status, contents = download_stage(filter_stage(papers, keywords), conference, year, fetcher)
    status, parsed = written(status), written(parse(contents.where("error is null")))
    summaries = written(summary_stage(parsed, completer, size=size))
    updates = parsed.select("pdf_path", F.lit("parsed").alias("parse_status"), F.col("stem").alias("parsed_dir"))
    done = parsed.join(summaries.where("status = 'ok'").select("stem"), "stem").select("pdf_path", F.lit("done").alias("report_status"), F.col("stem").alias("report_path"))
    status = tables.upsert_by_file(tables.upsert_by_file(status, updates, ["parse_status", "parsed_dir"]), done, ["report_status", "report_path"])
    return status, summaries, report_stage(status, parsed, summaries)


def _port(name: str) -> object:
    """The object that ``module:name`` makes when called without arguments."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="litlake", description="Stages over tables on disk")
    steps = parser.add_subparsers(dest="step", required=True)
    matching = steps.add_parser("filter", help="keyword filter with provenance")
    matching.add_argument("--input", required=True)
    matching.add_argument("--output", required=True)
    matching.add_argument("--keywords", nargs="+", required=True)
    matching.add_argument("--columns", nargs="+")
    matching.add_argument("--match-all", action="store_true")
    matching.add_argument("--regex", action="store_true")
    matching.add_argument("--case-sensitive", action="store_true")
    matching.add_argument("--types", nargs="*")
    matching.add_argument("--type-column", default="type")
    export = steps.add_parser("export", help="one line per title and address")
    export.add_argument("--input", required=True)
    export.add_argument("--output", required=True)
    export.add_argument("--template", default="+ {title} [Paper]({url})")
    fetch = steps.add_parser("fetch", help="paper table of a conference's year")
    fetch.add_argument("--conference", required=True)
    fetch.add_argument("--year", type=int, required=True)
    fetch.add_argument("--source", default="auto", choices=["auto", "openreview", "openaccess"])
    fetch.add_argument("--venue")
    fetch.add_argument("--url")
    fetch.add_argument("--patterns", nargs="*", default=[])
    fetch.add_argument("--output", required=True)
    download = steps.add_parser("download", help="files of a filtered table and its statuses")
    download.add_argument("--input", required=True)
    download.add_argument("--output", required=True)
    download.add_argument("--folder", required=True)
    download.add_argument("--conference")
    download.add_argument("--year", type=int)
    summarize = steps.add_parser("summarize", help="summaries of parsed papers as a table and as Markdown files")
    summarize.add_argument("--input", required=True)
    summarize.add_argument("--output", required=True)
    summarize.add_argument("--folder")
    summarize.add_argument("--completer", required=True, help="module:name of a completion port")
    summarize.add_argument("--chunk-chars", type=int, default=12_000)
    run = steps.add_parser("run", help="all stages; tables status, summaries and reports in a folder")
    run.add_argument("--conference", required=True)
    run.add_argument("--year", type=int, required=True)
    run.add_argument("--keywords", nargs="+", required=True)
    run.add_argument("--source", default="auto", choices=["auto", "openreview", "openaccess"])
    run.add_argument("--parser", required=True, help="module:name of what makes a parser: contents to parsed papers")
    run.add_argument("--completer", required=True, help="module:name of a completion port")
    run.add_argument("--chunk-chars", type=int, default=12_000)
    run.add_argument("--output", required=True)
    for step in (fetch, download, run):
        step.add_argument("--fetcher", default="litlake.ports:UrlFetcher", help="module:name of a fetching port")
    combine = steps.add_parser("combine", help="all report records of a folder")
    combine.add_argument("--input", required=True)
    combine.add_argument("--output", required=True)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("litlake").getOrCreate()
    if a.step == "filter":
        out = filter_stage(
            files.read_table(spark, a.input), a.keywords, columns=a.columns, match_all=a.match_all, regex=a.regex,
            case_sensitive=a.case_sensitive, allowed_types=a.types, type_column=a.type_column,
        )
        sinks.write_table(out, a.output)
    elif a.step == "export":
        table = files.read_table(spark, a.input)
        names = [files.detect_column(table, "title", ["title", "papertitle"]), files.detect_column(table, "url", ["url", "link", "pdf"])]
        rows = table.select(F.monotonically_increasing_id().alias("pos"), F.col(f"`{names[0]}`").alias("title"), F.col(f"`{names[1]}`").alias("url"))
        sinks.title_lines(rows, a.template).orderBy("pos").select("line").write.mode("overwrite").text(a.output)
    elif a.step == "fetch":
        papers = fetch_stage(spark, a.conference, a.year, _port(a.fetcher), source=a.source, venue=a.venue, url=a.url, patterns=a.patterns)
        sinks.write_table(papers, a.output)
    elif a.step == "run":
        made = run_stages(spark, a.conference, a.year, a.keywords, _port(a.fetcher), _port(a.parser), _port(a.completer), a.chunk_chars, source=a.source)
        for name, result in zip(("status", "summaries", "reports"), made, strict=True):
            sinks.write_table(result, f"{a.output}/{name}.parquet")
    elif a.step == "download":
        named = spark.range(1).select(t.source_of_file(F.lit(a.input.rstrip("/").rsplit("/", 1)[-1])).alias("s")).first()["s"]
        conference, year = a.conference or (named and named["conference"]), a.year or (named and int(named["year"]))
        if not conference or not year:
            raise ValueError("conference and year are neither given nor in the table's name")
        status, contents = download_stage(files.read_table(spark, a.input), conference, year, _port(a.fetcher))
        sinks.write_files(contents.where("error is null"), a.folder)
        sinks.write_table(status, a.output)
    elif a.step == "summarize":
        summaries = written(summary_stage(files.read_table(spark, a.input), _port(a.completer), size=a.chunk_chars))
        if a.folder:
            sinks.write_markdown(summaries, a.folder, "stem", "summary")
        sinks.write_table(summaries, a.output)
    else:
        sinks.write_table(files.read_reports(spark, a.input), a.output)


if __name__ == "__main__":
    main()
