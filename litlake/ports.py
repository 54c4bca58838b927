"""Ports to the outside world with deterministic stand-ins, and the map/reduce summary over them.

A port is any object with the method named; it is sent to the tasks, so it must
be picklable.  Calls are keyed by document, so a repeated task repeats the same
call and not another one.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.operators.sections import chunks
from litlake.session import cut_lineage, written


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> bytes: ...


class HashCompleter:
    """Answers with the SHA-1 of the prompt."""

    def complete(self, prompt: str) -> str:
        return hashlib.sha1(prompt.encode()).hexdigest()


class TableFetcher:
    """Answers from a dictionary; unknown addresses are errors."""

    def __init__(self, pages: dict[str, bytes]) -> None:
        self.pages = pages

    def fetch(self, url: str) -> bytes:
        return self.pages[url]


class HashFetcher:
    """Answers with the SHA-1 of the address, in hex; addresses without a host are errors."""

    def fetch(self, url: str) -> bytes:
        if "://" not in url:
            raise ValueError(f"no address: {url}")
        return hashlib.sha1(url.encode()).hexdigest().encode()


class UrlFetcher:
    """Fetches over HTTP with a time limit."""

    def __init__(self, timeout: float = 30.0) -> None:
        self.timeout = timeout

    def fetch(self, url: str) -> bytes:
        import urllib.request

        request = urllib.request.Request(url, headers={"User-Agent": "litlake"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read()


class Retrying:
    """A completer that tries again after a growing pause."""

    def __init__(self, inner: Completer, retries: int = 2, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.retries, self.pause, self.sleep = inner, retries, pause, sleep

    def complete(self, prompt: str) -> str:
        for n in range(self.retries + 1):
            try:
                return self.inner.complete(prompt)
            except Exception:
                if n == self.retries:
                    raise
                self.sleep(self.pause * (n + 1))
        raise AssertionError


def poll(status: Callable[[], str], timeout: float, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str:
    """Waits for a service's job: the final state, or an error for a failed state and a TimeoutError for none."""
    # Final states.
    done, failed = {"done", "success", "succeeded", "completed", "finished"}, {"failed", "error", "canceled", "cancelled"}
    end = clock() + timeout
    while True:
        state = status().lower()
        if state in done:
            return state
        if state in failed:
            raise RuntimeError(f"job ended as {state}")
        if clock() >= end:
            raise TimeoutError(f"no final state within {timeout} s")
        sleep(interval)


def complete_all(prompts: DataFrame, key: list[str], prompt: str, port: Completer) -> DataFrame:
    """(key, answer, error): one call per row; a failed call fills ``error`` and fails nothing else."""
    kinds = dict(prompts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for p in batch[prompt]:
                try:
                    answers.append(port.complete(p))
                    errors.append(None)
                except Exception as e:  # kept in the row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[key].assign(answer=answers, error=errors)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", answer string, error string"
    return prompts.select(*key, prompt).mapInPandas(run, schema)


def fetch_all(urls: DataFrame, key: str, url: str, port: Fetcher) -> DataFrame:
    """(key, content, error): one fetch per row."""
    kinds = dict(urls.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for u in batch[url]:
                try:
                    contents.append(port.fetch(u))
                    errors.append(None)
                except Exception as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: batch[key], "content": contents, "error": errors})

    return urls.select(key, url).mapInPandas(run, f"`{key}` {kinds[key]}, content binary, error string")


def summarize(docs: DataFrame, key: str, text: str, port: Completer, size: int = 12_000) -> DataFrame:
    """(key, summary, parts, error): each chunk is one call, the answers in order are one more; short texts need one call.

    The calls are made here, once each: all answers are written to the shared
    folder before they are used.  ``key`` must be unique.
    """
    parts = chunks(docs, key, text, size).withColumnRenamed("n", "part")
    answers = written(complete_all(parts, [key, "part"], "chunk", port))
    gathered = answers.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("a"), F.max("error").alias("error"), F.count("*").alias("parts")
    )
    prompt = F.array_join(F.transform("a", lambda x: F.concat(F.lit("### "), (x["part"] + 1).cast("string"), F.lit("\n"), x["answer"])), "\n\n")
    single = gathered.where("parts = 1 and error is null").select(key, F.col("a")[0]["answer"].alias("summary"), "parts", "error")
    several = gathered.where("parts > 1 and error is null").select(key, prompt.alias("prompt"), "parts")
    reduced = cut_lineage(complete_all(several, [key, "parts"], "prompt", port)).select(key, F.col("answer").alias("summary"), "parts", "error")
    failed = gathered.where("error is not null").select(key, F.lit(None).cast("string").alias("summary"), "parts", "error")
    return single.unionByName(reduced).unionByName(failed)
