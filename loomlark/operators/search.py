"""Line search: terms or pattern, date, tool, project and speaker filters, context, counts, order and limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.text import TOOL_SUFFIXES, lines, scrub_paths, speaker_of_line, truncate_line
from loomlark.functions.timeutil import within
from loomlark.operators.ordered import filled


def line_table(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key columns kept, ``pos`` from 1 and ``line``."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def matches(line: Column, query: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """All white-space-separated terms on one line, or a pattern. Case is folded unless asked."""
    if not query.strip():
        raise ValueError("the query is empty")
    if regex:
        return line.rlike(query if case_sensitive else f"(?iu){query}")
    held = line if case_sensitive else F.lower(line)
    terms = query.split() if case_sensitive else query.lower().split()
    found = F.contains(held, F.lit(terms[0]))
    for t in terms[1:]:
        found = found & F.contains(held, F.lit(t))
    return found


def with_speaker(rows: DataFrame, key: str) -> DataFrame:
    """``speaker`` of each line: of its prefix, else of the line before; at first ``other``."""
    return rows.withColumn("speaker", filled([key], ["pos"], speaker_of_line(F.col("line")), "other"))


@dataclass(frozen=True)
class Options:
    regex: bool = False
    case_sensitive: bool = False
    start: str | None = None
    end: str | None = None
    tool: str | None = None
    project: str | None = None
    speaker: str | None = None
    summaries_only: bool = False
    include_training: bool = False
    include_paths: bool = False
    context: int = 0
    limit: int | None = 50
    oldest_first: bool = False
    files_with_matches: bool = False
    count: bool = False
    json: bool = False
    semantic: bool = False

    def check(self) -> None:
        """Combinations that contradict each other, and unknown tools."""
        rules = (
            (self.count and self.files_with_matches, "counts and file lists exclude each other"),
            (self.semantic and self.regex, "semantic search takes no pattern"),
            (self.tool is not None and self.tool.lower() not in TOOL_SUFFIXES, f"unknown tool: {self.tool}"),
            (self.tool is not None and self.summaries_only, "summaries cover all tools"),
            (self.project is not None and self.summaries_only, "summaries cover all projects"),
            (self.project is not None and self.include_training, "training files name no project"),
            (self.project is not None and self.semantic, "indexed chunks carry no project"),
            (self.speaker is not None and self.summaries_only, "summaries have no speakers"),
            (self.speaker is not None and self.include_training, "training files have no speakers"),
            (self.speaker is not None and self.semantic, "indexed chunks carry no speaker"),
        )
        for broken, why in rules:
            if broken:
                raise ValueError(why)


#: Order of artifact classes in results.
ARTIFACTS = ("monthly", "daily", "session", "training")


def in_scope(o: Options) -> Column:
    """Artifact gates and column filters over (artifact, month, day, tool, project). All are plain
    predicates, so months prune partitions and the others are pushed into the scan."""
    artifact = F.col("artifact")
    if o.summaries_only:
        ok = artifact.isin("monthly", "daily")
    elif o.tool is not None or o.project is not None or o.speaker is not None:
        ok = artifact.isin(*(["session", "training"] if o.include_training else ["session"]))
    else:
        ok = artifact.isin("monthly", "daily", "session", *(["training"] if o.include_training else []))
    ok = ok & within(F.col("month"), F.col("day"), o.start, o.end)
    if o.tool is not None:
        ok = ok & (F.lower("tool") == o.tool.lower())
    if o.project is not None:
        ok = ok & F.contains(F.lower("project"), F.lit(o.project.lower()))
    return ok


def context_lines(rows: DataFrame, key: str, hit: str, n: int) -> DataFrame:
    """Lines within ``n`` of a hit that are no hits themselves, each with its ``owner``: the first hit that covers it.
    A window of 2n+1 rows stands for the range join."""
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-n, n)
    owner = F.min(F.when(F.col(hit), F.col("pos"))).over(near)
    return rows.withColumn("owner", owner).where(~F.col(hit) & F.col("owner").isNotNull())


def search(rows: DataFrame, query: str, o: Options = Options()) -> DataFrame:
    """``rows``: path, artifact, month, day, tool, project, pos, line. Line output has one row per hit with ``context``; its limit is checked
    after each file, so that the hits of the file that reaches it are all there. ``count`` gives hits per path and
    ``files_with_matches`` paths, at most ``limit`` files. A limit of 0 gives nothing, whatever the other options."""
    if o.limit != 0:
        o.check()
    scoped = rows.where(in_scope(o))
    hit = matches(F.col("line"), query, o.regex, o.case_sensitive)
    if o.speaker is not None:
        scoped = with_speaker(scoped, "path")
        hit = hit & (F.col("speaker") == o.speaker.lower())
    rank = F.array_position(F.array(*map(F.lit, ARTIFACTS)), F.col("artifact"))
    order = [F.col("rank"), F.col("path").asc() if o.oldest_first else F.col("path").desc()]
    if o.count or o.files_with_matches:
        out = scoped.where(hit).groupBy("path", rank.alias("rank")).agg(F.count("*").alias("hits")).orderBy(*order)
        out = out.select("path", "hits") if o.count else out.select("path")
        out = out if o.limit is None else out.limit(o.limit)
    else:
        shown = F.col("line") if o.include_paths else scrub_paths(F.col("line"))
        if o.context > 0:
            scoped = scoped.withColumn("_hit", hit)
            around = context_lines(scoped, "path", "_hit", o.context).groupBy(F.col("path").alias("_p"), "owner").agg(F.array_sort(F.collect_list(F.struct("pos", truncate_line(shown, 200).alias("line")))).alias("context"))
            hits = scoped.where("_hit").join(around, (F.col("path") == F.col("_p")) & (F.col("pos") == F.col("owner")), "left")
        else:
            hits = scoped.where(hit).withColumn("context", F.lit(None).cast("array<struct<pos:int,line:string>>"))
        hits = hits.withColumn("rank", rank)
        if o.limit is not None:
            hits = file_limited(hits, o.limit, o.oldest_first)
        out = hits.orderBy(*order, "pos").select("path", "artifact", "pos", truncate_line(shown, 280).alias("line"), "context")
    return out.select(F.to_json(F.struct("*")).alias("json")) if o.json else out


def file_limited(hits: DataFrame, limit: int, oldest_first: bool = False) -> DataFrame:
    """The limit that is checked after each file: whole files until ``limit`` hits are reached. ``hits``: rank, path, pos.
    At most ``limit`` files can be needed, as each has a hit, so the running sum is over that many rows."""
    order = [F.col("rank"), F.col("path").asc() if oldest_first else F.col("path").desc()]
    per = hits.groupBy("rank", "path").agg(F.count("*").alias("_n")).orderBy(*order).limit(limit)
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = per.withColumn("_before", before).where(F.col("_before") < limit).select("rank", "path")
    return hits.join(kept, ["rank", "path"], "left_semi")
