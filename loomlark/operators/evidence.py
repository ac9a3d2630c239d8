"""Structured evidence: merge of daily blocks into weekly ones, validation, and the loss audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlark.functions.text import trimmed

#: Outcome labels from least to most severe; others rank 0 (fixed values).
SEVERITY = ("autonomous_success", "first_pass", "rework", "hardening", "deferred", "abandoned")
MAX_QUOTES = 10


def severity(result: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), result), F.lit(0))


def volumes(parts: DataFrame, *by: str, measures: tuple[str, ...]) -> DataFrame:
    """Sums in which null plus n is n and null plus null stays null: the rule of SQL's own sum."""
    return parts.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def agents(parts: DataFrame, *by: str, tool: str = "tool", model: str = "model", measures: tuple[str, ...]) -> DataFrame:
    return parts.groupBy(*by, tool, F.coalesce(model, F.lit("")).alias(model)).agg(*[F.sum(m).alias(m) for m in measures])


def first_wins(parts: DataFrame, by: list[str], key: Column, order: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the payload of its first part."""
    return parts.groupBy(*by, key.alias("key")).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_p")).select(*by, "key", *[F.col(f"_p.{c}").alias(c) for c in payload])


def worst_wins(parts: DataFrame, by: list[str], unit: str, order: list[str], result: str = "result", sessions: str = "sessions", notes: str = "notes") -> DataFrame:
    """One row per unit: its most severe result (of equals, the first), the sum of sessions, the first note."""
    worst = F.max_by(result, F.struct(severity(F.col(result)), *[-F.col(o) for o in order]))
    note = F.min_by(notes, F.when(F.col(notes).isNotNull(), F.struct(*order)))
    return parts.groupBy(*by, unit).agg(worst.alias(result), F.sum(sessions).alias(sessions), note.alias(notes))


def quotes(parts: DataFrame, by: list[str], quote: str, is_correction: str, order: list[str], most: int = MAX_QUOTES) -> DataFrame:
    """Distinct quotes, those of corrections first in their own order, then the others by ``order``; at most ``most`` (that limit is the feature)."""
    one = parts.where(F.col(quote).isNotNull()).groupBy(*by, quote).agg(F.bool_or(is_correction).alias("_c"), F.min(F.struct(*order)).alias("_o"))
    place = [F.desc("_c"), F.when(F.col("_c"), F.col(quote)), "_o", quote]
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*place))).where(F.col("rank") <= most).drop("_c", "_o")


def string_union(parts: DataFrame, by: list[str], values: str) -> DataFrame:
    """Sorted union of array columns without blank strings."""
    return parts.select(*by, F.explode(values).alias("_v")).where(trimmed(F.col("_v")) != "").groupBy(*by).agg(F.array_sort(F.collect_set("_v")).alias(values))


def missing(expected: DataFrame, actual: DataFrame, value: str, fold: bool = False) -> DataFrame:
    """Expected values that the actual side lost."""
    k = (lambda c: F.lower(trimmed(c))) if fold else (lambda c: c)
    return expected.join(actual.select(k(F.col(value)).alias("_a")), k(F.col(value)) == F.col("_a"), "left_anti")


def retention(expected: DataFrame, actual: DataFrame, value: str, fold: bool = False) -> DataFrame:
    """n_expected, n_kept, ratio; an expected value counts as often as it is listed, and nothing expected counts as 1."""
    k = (lambda c: F.lower(trimmed(c))) if fold else (lambda c: c)
    seen = actual.select(k(F.col(value)).alias("_a")).distinct().withColumn("_hit", F.lit(1))
    rows = expected.select(k(F.col(value)).alias("_e")).join(seen, F.col("_e") == F.col("_a"), "left")
    out = rows.agg(F.count("*").alias("n_expected"), F.count("_hit").alias("n_kept"))
    return out.withColumn("ratio", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_kept") / F.col("n_expected")))


def _listed(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def loss_audit(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Both sides: key and ``e``, an evidence block. Per key that both have: the share of quotes and of instruction deltas (by folded summary) that is
    kept, with each listed entry counted, what is missing, whether the corrections agree (by their stated or by their listed number), and whether the gate passes."""
    both = expected.select(key, F.col("e").alias("_x")).join(actual.select(F.col(key).alias("_k"), F.col("e").alias("_y")), F.col(key) == F.col("_k"))
    text = lambda c: _listed(c, "array<string>")
    fold = lambda c: F.lower(trimmed(c))
    quoted, kept = text(F.col("_x.case_study_quotes")), text(F.col("_y.case_study_quotes"))
    deltas, deltas_kept = text(F.col("_x.instruction_deltas.summary")), F.transform(text(F.col("_y.instruction_deltas.summary")), fold)
    lost_quotes, lost_deltas = F.filter(quoted, lambda q: ~F.array_contains(kept, q)), F.filter(deltas, lambda d: ~F.array_contains(deltas_kept, fold(d)))
    ratio = lambda lost, whole: F.when(F.size(whole) == 0, 1.0).otherwise(1.0 - F.size(lost) / F.size(whole))
    number = lambda side: F.size(text(F.col(f"{side}.corrections.quote")))
    stated = lambda side: F.coalesce(F.col(f"{side}.volume.corrections"), F.lit(0))
    out = both.select(key, lost_quotes.alias("missing_quotes"), lost_deltas.alias("missing_deltas"), ratio(lost_quotes, quoted).alias("quote_retention"), ratio(lost_deltas, deltas).alias("delta_retention"), number("_x").alias("expected_corrections"), number("_y").alias("actual_corrections"), ((stated("_x") == stated("_y")) | (number("_x") == number("_y"))).alias("corrections_match"))
    return out.withColumn("passes", passes(F.col("quote_retention"), F.col("delta_retention"), F.col("corrections_match")))


def passes(quote_ratio: Column, delta_ratio: Column, corrections_equal: Column) -> Column:
    """The gate: most quotes, all deltas, as many corrections."""
    return (quote_ratio >= 0.8) & (delta_ratio == 1.0) & corrections_equal


#: Labels that validation knows (fixed values).
CORRECTION_TYPES = ("over_abstraction", "ignored_clean_break", "wrong_boundary", "tool_misuse", "ignored_instruction", "over_hedging", "terminology", "other")
OUTCOME_RESULTS = (*SEVERITY, "unknown")


def warnings(e: Column) -> Column:
    """Messages on an evidence block (a struct as ``sources.artifacts.EVIDENCE``), empty if all is well: on the period, its kind, the stated number of
    corrections, the number of quotes, then on each correction and each outcome."""
    known = lambda labels: F.array(*map(F.lit, labels))
    blank = lambda c: trimmed(F.coalesce(c, F.lit(""))) == ""
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    kind, stated = F.coalesce(e["period_kind"], F.lit("day")), F.coalesce(e["volume"]["corrections"], F.lit(0))
    corrections, outcomes = _listed(e["corrections"], "array<struct<type:string,quote:string,context:string,codified_into:string>>"), _listed(e["outcomes"], "array<struct<unit:string,result:string,sessions:bigint,notes:string>>")
    n, quoted = F.size(corrections), F.size(_listed(e["case_study_quotes"], "array<string>"))
    whole = F.array(
        F.when(blank(e["period"]), "period is empty"),
        F.when(~kind.isin("day", "week"), say("period_kind should be day|week, got ", kind)),
        F.when((stated != n) & (n > 0), say("volume.corrections=", stated, " disagrees with corrections.len()=", n)),
        F.when(quoted > MAX_QUOTES, say("case_study_quotes has ", quoted, f" entries (cap {MAX_QUOTES})")),
    )
    label = lambda c: F.coalesce(c, F.lit(""))
    each = F.transform(corrections, lambda c: F.array(F.when(~F.array_contains(known(CORRECTION_TYPES), label(c["type"])), say("unknown correction type: ", label(c["type"]))), F.when(blank(c["quote"]), "correction with empty quote")))
    ends = F.transform(outcomes, lambda o: F.when(~F.array_contains(known(OUTCOME_RESULTS), label(o["result"])), say("unknown outcome result: ", label(o["result"]))))
    return F.array_compact(F.concat(whole, F.flatten(each), ends))


def merge(parts: DataFrame, by: list[str], order: str, kind: str = "week") -> DataFrame:
    """Evidence blocks (``e``) of each group made one, in order of ``order``: by, period_kind, and the fields of a block. Volumes and agents are summed, strings
    united and sorted, the first delta of a folded summary and the first correction of a quote stand, of outcomes of a folded unit the worst;
    quotes of corrections come first; the first reference to metrics that is not empty stands; notes are joined.

    Every field is an aggregation with map-side combining; a group's fields are joined by its key."""
    _p = "_place"

    def exploded(field: str) -> DataFrame:
        return parts.select(*by, order, F.posexplode(F.col(f"e.{field}")).alias("_k", "_v")).select(*by, F.struct(F.col(order).alias("_at"), "_k").alias(_p), "_v")

    def listed(rows: DataFrame, sort: list[str], fields: list[str], name: str) -> DataFrame:
        inner = F.struct(*fields)
        gathered = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(sort)], inner.alias("v"))))
        return rows.groupBy(*by).agg(F.transform(gathered, lambda s: s["v"]).alias(name))

    sums = parts.groupBy(*by).agg(
        F.struct(F.coalesce(F.sum("e.volume.sessions"), F.lit(0)).alias("sessions"), F.sum("e.volume.user_turns").alias("user_turns"), F.coalesce(F.sum("e.volume.decisions"), F.lit(0)).alias("decisions")).alias("_volume"),
        F.min_by("e.metrics_ref", F.when(F.coalesce("e.metrics_ref", F.lit("")) != "", F.col(order))).alias("metrics_ref"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(trimmed(F.coalesce("e.notes", F.lit(""))) != "", F.struct(F.col(order).alias("_at"), F.col("e.notes").alias("_n"))))), lambda s: s["_n"]), " | "), F.lit("")).alias("notes"),
    )
    first = lambda c: F.min_by(c, _p)
    v = lambda f: F.col(f"_v.{f}")
    key = lambda c: F.lower(trimmed(c))
    used = exploded("agents_used").groupBy(*by, v("tool").alias("tool"), F.coalesce(v("model"), F.lit("")).alias("_m")).agg(first(v("model")).alias("model"), F.coalesce(F.sum(v("sessions")), F.lit(0)).alias("sessions"), *[F.sum(v(f)).alias(f) for f in ("tokens_in", "tokens_out", "cost_usd")])
    deltas = exploded("instruction_deltas").groupBy(*by, key(v("summary")).alias("_key")).agg(first("_v").alias("_v")).select(*by, "_key", "_v.*")
    corrections = exploded("corrections").groupBy(*by, v("quote").alias("_key")).agg(first("_v").alias("_v")).select(*by, "_key", "_v.*")
    worst = F.max_by(v("result"), F.struct(severity(v("result")), (-F.col(f"{_p}._at")), (-F.col(f"{_p}._k"))))
    outcomes = exploded("outcomes").groupBy(*by, key(v("unit")).alias("_key")).agg(first(v("unit")).alias("unit"), worst.alias("result"), F.sum(v("sessions")).alias("sessions"), F.min_by(v("notes"), F.when(v("notes").isNotNull(), F.col(_p))).alias("notes"))
    said = exploded("case_study_quotes").select(*by, _p, F.col("_v").alias("quote"), F.lit(False).alias("_c")).unionByName(exploded("corrections").select(*by, _p, v("quote").alias("quote"), F.lit(True).alias("_c")))
    fields = [
        *[string_union(parts.select(*by, F.col(f"e.{f}").alias(f)), by, f) for f in ("projects", "process_invocations", "open_threads")],
        listed(used, ["tool", "_m"], ["tool", "model", "sessions", "tokens_in", "tokens_out", "cost_usd"], "agents_used"),
        listed(deltas, ["_key"], ["summary", "target", "quote", "codified"], "instruction_deltas"),
        listed(corrections, ["_key"], ["type", "quote", "context", "codified_into"], "corrections"),
        listed(outcomes, ["_key"], ["unit", "result", "sessions", "notes"], "outcomes"),
        quotes(said, by, "quote", "_c", [_p]).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda s: s["quote"]).alias("case_study_quotes")),
    ]
    out = sums
    for f in fields:
        out = out.join(f.select(*[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], f.columns[-1]), reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b{k}")) for k, b in enumerate(by)]), "left").drop(*[f"_b{k}" for k in range(len(by))])
    volume = F.struct("_volume.sessions", "_volume.user_turns", F.coalesce(F.size("corrections"), F.lit(0)).cast("long").alias("corrections"), "_volume.decisions")
    empty = {f.columns[-1]: f.schema[f.columns[-1]].dataType.simpleString() for f in fields}
    return out.select(*by, F.lit(kind).alias("period_kind"), volume.alias("volume"), *[_listed(F.col(c), t).alias(c) for c, t in empty.items()], "metrics_ref", "notes")
