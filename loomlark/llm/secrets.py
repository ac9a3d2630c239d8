"""Operator 6, secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds (blob, rule version,
spans); only pairs that it lacks are scanned, each distinct blob once, and the findings are joined back to all
paths. A hot blob meets its findings in a join that Spark can split (AQE).

How a span is found without a Python function: each rule's matches are wrapped in two marker characters by
one regexp_replace, the text is split at the markers, and running lengths of the parts give code-point
positions. Marker characters of the text itself are first replaced by another character that no rule reads,
which keeps all positions.

Cases: null text is an empty blob; no match gives empty spans and the digest of the empty string; repeated
rows and null ids keep their rows; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlark.llm.ledger import addressed, unseen
from loomlark.llm.shared import fresh_path, text_or_empty, unused, written

#: kind, pattern, cheap necessary pattern, least length of the group that counts, that group (fixed values).
RULES: tuple[tuple[str, str, str, int, int], ...] = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 18, 0),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{16}", 16, 0),
)
#: A maximal run is matched by either form, and the second makes no short matches.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
_OPEN, _SPARE = "\ue000", "\ue001"
#: Raised with any change of how ``find_spans`` works beside the patterns: findings of earlier versions are not served.
SCANNER = 1
LEDGER = "digest binary, version string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def rule_version() -> str:
    import hashlib

    return hashlib.sha256(repr((RULES, _LONG, _OPEN, _SPARE, SCANNER)).encode()).hexdigest()


def _spans(text: Column, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of one rule, in code points, end exclusive."""
    kind, pattern, gate, least, group = RULES[rank]
    clean = F.translate(text, _OPEN, _SPARE)
    parts = F.split(F.regexp_replace(clean, _LONG.get(kind, pattern), f"{_OPEN}$0{_OPEN}"), _OPEN)
    # odd parts are matches; the fold carries the position and gathers them
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(held: Column, part: Column) -> Column:
        end = held["at"] + F.length(part)
        inner = F.length(F.regexp_extract(part, pattern, group)) if group else F.length(part)
        hit = held["odd"] & (inner >= least)
        span = F.struct(held["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), (~held["odd"]).alias("odd"), F.when(hit, F.concat(held["found"], F.array(span))).otherwise(held["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("found")), step, lambda held: held["found"])
    return F.when(text.rlike(gate), found).otherwise(empty)


def find_spans(text: Column) -> Column:
    """All spans of a text, by start and then by rule."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(RULES))]))


def _ledger(docs: DataFrame, key: str, ledger_path: str | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``key`` and digest of every row of ``docs``, and digest and spans of every distinct content."""
    spark = docs.sparkSession
    content = text_or_empty(F.col("text"))
    version = rule_version()
    rows = written(addressed(docs, key, content).drop("n_bytes"), "blobs")
    store = None
    if ledger_path is None:
        ledger_path = fresh_path(spark, "ledger")
    else:
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
        store = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("version") == version)
    new = unseen(docs, rows, key, content, store)
    new.select("digest", F.lit(version).alias("version"), find_spans(F.col("text")).alias("spans")).write.mode("append").parquet(ledger_path)
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("version") == version).dropDuplicates(["digest"])
    # written, so that nothing stands between a join and its exchanges and a hot blob's paths can be split
    return rows, written(known.select("digest", "spans"), "findings")


def scan(docs: DataFrame, key: str = "doc_id", ledger_path: str | None = None) -> DataFrame:
    """key, digest, spans for every row of ``docs`` (key, text). ``ledger_path``: a Parquet folder of earlier
    findings, appended to; without one, a new ledger in the shared folder serves this call."""
    rows, known = _ledger(docs, key, ledger_path)
    return rows.join(known, "digest").select(F.col("key").alias(key), "digest", "spans")


def redact(docs: DataFrame, key: str = "doc_id", mask: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """``docs``, columns as they are, with every span of its texts replaced by ``mask``; ``n_chars`` follows where there is one.
    Only contents with findings are joined; both sides are scans, so a hot content can be split."""
    own, other, spans = (unused(docs, n) for n in ("__own", "__digest", "__spans"))
    _, known = _ledger(docs, key, ledger_path)
    found = written(known.where(F.size("spans") > 0).select(F.col("digest").alias(other), F.col("spans").alias(spans)), "secrets")
    marked = docs.withColumn(own, F.unhex(F.sha2(text_or_empty(F.col("text")), 256)))
    hit = F.col(spans).isNotNull()
    # a merge join by hint: whether Spark would broadcast follows the number of findings, which no bound holds
    out = marked.join(found.hint("merge"), F.col(own) == F.col(other), "left").withColumn("text", F.when(hit, redacted(F.col("text"), F.col(spans), mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlaps merged, replaced by ``mask``."""

    def step(held: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= held["at"], F.concat(text.substr(held["at"] + 1, s["start"] - held["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), F.concat(held["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substr(text, held["at"] + 1)))).otherwise(text)
