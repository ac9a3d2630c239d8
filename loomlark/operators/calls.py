"""Calls to a language model: assembled inputs, retries by class of failure, results and status as tables.

The model is a callable ``(text) -> text`` that the user gives; it runs on executors. A call that fails for good is a row, not a failure of the job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlark.operators.compact import MAX_INPUT_BYTES, uncached
from loomlark.operators.ordered import greedy_chunks
from loomlark.session import ship

#: Classes of failure; the first four may pass when tried again (fixed values).
CLASSES = ("timeout", "process", "provider_http_error", "transport", "parse_error", "empty_response", "io")
RETRYABLE = CLASSES[:4]
ATTEMPTS, BACKOFF_SECONDS = 3, (2, 5)

#: What a model is asked, in our own words.
PROMPTS = {
    "day": "Summarise one day of work sessions. Group what was done by project, name decisions with their reasons, list corrections that the user had to make with the user's words, and end with open ends. Close with a CaseStudyEvidence section.",
    "day_merge": "These are partial summaries of one day. Merge them into one report: keep every decision, correction and quote once, resolve repetitions, and merge the CaseStudyEvidence sections.",
    "week": "These are the daily reports of one week. Write the week: what moved in each project, which instructions changed, which corrections recur, what stays open. Close with a CaseStudyEvidence section for the week.",
    "month": "These are reports of one month. Write the month: results by project, changes in how work was done, recurring corrections, and what to carry over.",
}


class CallError(Exception):
    """A failure that the callable classifies itself."""

    def __init__(self, kind: str, detail: str = ""):
        if kind not in CLASSES:
            raise ValueError(f"unknown class of failure: {kind}")
        super().__init__(detail)
        self.kind = kind


def failure_class(error: BaseException) -> str:
    if isinstance(error, CallError):
        return error.kind
    for kind, types in (("timeout", TimeoutError), ("transport", ConnectionError), ("io", OSError), ("parse_error", ValueError)):
        if isinstance(error, types):
            return kind
    return "process"


def attempts(call: Callable[[str], str], text: str, most: int = ATTEMPTS, backoff: tuple[float, ...] = BACKOFF_SECONDS, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, list[dict]]:
    """The output, if any, and an event for each attempt: retry_count, outcome (success, retry, failure), failure_class, detail, elapsed_ms."""
    events: list[dict] = []
    for n in range(most):
        began = time.monotonic()
        output, kind, detail = None, None, None
        try:
            output = call(text)
            if not (output or "").strip():
                output, kind, detail = None, "empty_response", "the model gave nothing"
        except Exception as e:
            kind, detail = failure_class(e), str(e)
        again = kind in RETRYABLE and n + 1 < most
        events.append({"retry_count": n, "outcome": "retry" if again else "failure" if kind else "success", "failure_class": kind, "detail": detail, "elapsed_ms": int(1000 * (time.monotonic() - began))})
        if not again:
            return output, events
        sleep(backoff[min(n, len(backoff) - 1)])
    return None, events


def assembled(items: DataFrame, period: str, name: str, text: str, prompt: str, budget: int = MAX_INPUT_BYTES, what: str = "sessions") -> DataFrame:
    """period, chunk, chunks, input: the prompt and the items of each chunk, in order of name, with marks around and between them. All in one chunk where it
    fits, else chunks by greedy packing; an item beyond the budget stands alone."""
    overhead = len(prompt.encode()) + 100
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = items.select(period, F.col(name).cast("string").alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_text"), size.alias("_size"), (size + F.octet_length(F.col(name).cast("string")) + 30).cast("long").alias("_item"))
    total = rows.groupBy(F.col(period).alias("_p")).agg(F.sum("_size").alias("_total"))
    rows = greedy_chunks(rows, [period], ["_name"], "_item", max(1, budget - overhead)).join(total, F.col(period).eqNullSafe(F.col("_p")))
    rows = rows.withColumn("chunk", F.when(F.col("_total") + overhead <= budget, F.lit(0)).otherwise(F.col("chunk")))
    part = F.concat(F.col("_text"), F.lit("\n--- end of "), F.col("_name"), F.lit(" ---\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_name", part.alias("p")))), lambda s: s["p"]), "")
    made = rows.groupBy(period, "chunk").agg(F.concat(F.lit(f"{prompt}\n\n=== {what} of "), F.first(F.col(period).cast("string")), F.lit(": "), F.count("*").cast("string"), F.lit(" ===\n\n"), body, F.lit("=== end ===\n")).alias("input"))
    number = made.groupBy(F.col(period).alias("_p")).agg(F.count("*").alias("chunks"))
    return made.join(number, F.col(period).eqNullSafe(F.col("_p"))).select(period, "chunk", "chunks", "input", F.sha2("input", 256).alias("digest"))


def called(inputs: DataFrame, period: str, call: Callable[[str], str], cache: DataFrame | None = None, **how) -> DataFrame:
    """period, chunk, chunks, digest, output, events of every input without a stored output for the same digest. Write it and append it to
    the cache: a run that was cut off then repeats only what it lacks."""
    ship(inputs.sparkSession)
    todo = inputs if cache is None else uncached(inputs, cache.where("output is not null"), period, "chunk", "digest")
    kind = inputs.schema[period].dataType.simpleString()
    event = "array<struct<retry_count:int,outcome:string,failure_class:string,detail:string,elapsed_ms:bigint>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [attempts(call, t, **how) for t in batch["input"]]
            yield batch[[period, "chunk", "chunks", "digest"]].assign(output=[o for o, _ in found], events=[e for _, e in found])

    return todo.select(period, "chunk", "chunks", "digest", "input").mapInPandas(run, f"`{period}` {kind}, chunk int, chunks long, digest string, output string, events {event}")


def status(results: DataFrame, period: str) -> DataFrame:
    """period, total_chunks, completed_chunks, status (complete, failed, partial), and the first failure's class and detail. Of repeated results of a chunk,
    one with an output stands."""
    last = F.element_at("events", -1)
    per = results.groupBy(period, "chunk").agg(F.max("chunks").alias("chunks"), F.bool_or(F.col("output").isNotNull()).alias("done"), F.max(F.when(F.col("output").isNull(), F.struct(last["failure_class"].alias("c"), last["detail"].alias("d")))).alias("f"))
    done, total = F.count(F.when(F.col("done"), 1)), F.max("chunks")
    failed: Column = F.min_by("f", F.when(~F.col("done"), F.col("chunk")))
    return per.groupBy(period).agg(total.alias("total_chunks"), done.alias("completed_chunks"), F.when(done == total, "complete").when(F.count(F.when(~F.col("done"), 1)) > 0, "failed").otherwise("partial").alias("status"), failed["c"].alias("failure_class"), failed["d"].alias("failure_detail"))


def with_evidence(reports: DataFrame, merged: DataFrame, period: str, text: str = "text") -> DataFrame:
    """Reports (period, text) with the merged evidence (period, and the fields of a block) appended where their text has no evidence section. The block is JSON, which
    YAML readers read."""
    fields = [c for c in merged.columns if c != period]
    block = merged.select(F.col(period).alias("_p"), F.to_json(F.struct(F.col(period).cast("string").alias("period"), *fields), {"pretty": "true"}).alias("_block"))
    lacks = ~F.col(text).rlike(r"(?s)## CaseStudyEvidence.*?```(?:yaml|yml)\s*\n.*?```")
    section = F.concat(F.col(text), F.lit("\n\n## CaseStudyEvidence\n\n```yaml\n"), F.col("_block"), F.lit("\n```\n"))
    out = reports.join(block, F.col(period).eqNullSafe(F.col("_p")), "left")
    return out.withColumn(text, F.when(lacks & F.col("_block").isNotNull(), section).otherwise(F.col(text))).drop("_p", "_block")
