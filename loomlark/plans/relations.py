"""Pairing, change detection, joins, set operations, evidence, compaction planning, JSON and time functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlark.functions import digests, timeutil
from loomlark.operators import calls, compact, evidence, names
from loomlark.plans.lines import _PACK, _TRANSCRIPT, transcript_lines
from loomlark.plans.registry import Registry, table
from loomlark.sources import model, scan
from loomlark.sources.artifacts import EVIDENCE

R = Registry()


def _calls(spark, sf_dir):
    """Events as items of sessions: views are calls, purchases results, all of one call id; clicks name a model."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    item = F.when(kind == "view", "call").when(kind == "purchase", "tool_result").when(kind == "click", "model_change").otherwise("other")
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("pos"), F.lit(0).alias("k"), item.alias("kind"), F.lit("c").alias("call_id"), F.when(kind == "view", F.col("event_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("input"), F.when(kind == "click", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"))


@R.add("""
WITH r AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS call_id FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, call_id, event_id AS result_id FROM r WHERE event_type = 'purchase' AND before = 'view'""")
def call_result_pairing(spark, sf_dir):
    """The pairing of the dialects: results without an open call go."""
    rows = _calls(spark, sf_dir).where(F.col("kind").isin("call", "tool_result"))
    return model.paired(rows, model.Rules("any")).where("kind = 'tool_result'").select(F.col("path").alias("user_id"), F.col("name").cast("long").alias("call_id"), F.col("pos").alias("result_id"))


@R.add("""
WITH r AS (SELECT user_id, event_id, 'm' || event_id % 3 AS model, lag('m' || event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type = 'click')
SELECT user_id, event_id, model FROM r WHERE model IS DISTINCT FROM before""")
def model_change(spark, sf_dir):
    """The change detection of the dialects, among other items."""
    return model.models_changed(_calls(spark, sf_dir)).where("kind = 'model_change'").select(F.col("path").alias("user_id"), F.col("pos").alias("event_id"), "model")


_MINUTES = "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%dT%H-00-00') || '-' || CASE event_id % 2 WHEN 0 THEN 'claude' ELSE 'pi' END AS stem, 'in/' || lpad(event_id::VARCHAR, 7, '0') AS path FROM events"


@R.add(f"""
WITH e AS ({_MINUTES}), n AS (SELECT *, row_number() OVER (PARTITION BY month, stem ORDER BY path) AS k FROM e)
SELECT event_id, month, CASE WHEN k = 1 THEN stem ELSE regexp_replace(stem, '-(claude|pi)$', '-' || sha256(path)[1:8] || '-\\1') END AS name FROM n""")
def collision_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts")
    name = names.output_name(hour, F.when(F.col("event_id") % 2 == 0, "claude").otherwise("pi"))
    e = e.select("event_id", name["month"].alias("month"), name["stem"].alias("stem"), F.concat(F.lit("in/"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("path"))
    return names.without_collisions(e, "month", "stem", "path").select("event_id", "month", "name")


_NAMES = """
n AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') || '-' || CASE event_id % 3 WHEN 0 THEN 'claude-chat' WHEN 1 THEN 'codex' ELSE 'other' END || CASE event_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.training.json' WHEN 2 THEN '.daily.md' ELSE '.md' END AS name FROM events)"""


@R.add(f"""
WITH {_NAMES} SELECT event_id, CASE WHEN ends_with(name, '.daily.md') THEN 'daily' WHEN ends_with(name, '.training.json') THEN 'training' ELSE 'session' END AS artifact,
  CASE WHEN event_id % 5 IN (0, 3, 4) AND event_id % 3 < 2 THEN name[1:10] ELSE '' END AS date, CASE WHEN event_id % 5 IN (0, 3, 4) AND event_id % 3 < 2 THEN CASE event_id % 3 WHEN 0 THEN 'claude-chat' ELSE 'codex' END ELSE '' END AS tool FROM n""")
def file_names(spark, sf_dir):
    i = F.col("event_id")
    tool = F.when(i % 3 == 0, "claude-chat").when(i % 3 == 1, "codex").otherwise("other")
    end = F.when(i % 5 == 0, ".txt").when(i % 5 == 1, ".training.json").when(i % 5 == 2, ".daily.md").otherwise(".md")
    name = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), tool, end)
    parsed = names.session_name(name)
    return table(spark, sf_dir, "events").select("event_id", names.artifact_of(name).alias("artifact"), F.coalesce(parsed["date"], F.lit("")).alias("date"), F.coalesce(parsed["tool"], F.lit("")).alias("tool"))


@R.add("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE day(ts) % 3 <> 0 ORDER BY day LIMIT 12")
def pending_days(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    done = days.where(F.substring("day", 9, 2).cast("int") % 3 == 0).distinct()
    return compact.pending(days, done, "day", 12)


_REPORTS = """
WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events),
w AS (SELECT DISTINCT strftime(day, '%G-W%V') AS week, strftime(date_trunc('week', day), '%Y-%m') AS month FROM d WHERE week(day) % 3 = 0),
m AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM d WHERE month(day) % 4 <> 0)"""


def _reports(spark, sf_dir):
    """A daily report for each day of events, a weekly one for every third week, a monthly one for every fourth month."""
    day = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    month = F.date_format("d", "yyyy-MM").alias("month")
    daily = day.select(month, F.concat(F.col("d").cast("string"), F.lit(".daily.md")).alias("name"))
    weekly = day.where(F.weekofyear("d") % 3 == 0).select(F.date_format(timeutil.monday(F.col("d")), "yyyy-MM").alias("month"), F.concat(timeutil.iso_week(F.col("d")), F.lit(".weekly.md")).alias("name")).distinct()
    monthly = day.where(F.month("d") % 4 == 0).select(month, F.concat(F.date_format("d", "yyyy-MM"), F.lit(".monthly.md")).alias("name")).distinct()
    return daily.unionByName(weekly).unionByName(monthly)


@R.add(_REPORTS + " SELECT strftime(day, '%G-W%V') AS week, strftime(day, '%Y-%m-%d') || '.daily.md' AS name FROM d WHERE week(day) % 3 <> 0")
def pending_weeks(spark, sf_dir):
    return compact.of_pending_weeks(_reports(spark, sf_dir)).select("week", "name")


@R.add(_REPORTS + """
SELECT month, 'weekly' AS kind, week || '.weekly.md' AS name FROM w JOIN m USING (month)
UNION ALL SELECT month, 'daily', strftime(day, '%Y-%m-%d') || '.daily.md' FROM d JOIN m ON month = strftime(day, '%Y-%m') WHERE month NOT IN (SELECT month FROM w)""")
def pending_months(spark, sf_dir):
    return compact.of_pending_months(_reports(spark, sf_dir)).select("month", "kind", "name")


@R.add(f"""
WITH {_TRANSCRIPT}, m AS (SELECT *, CASE WHEN starts_with(line, '👤') THEN 'u' WHEN starts_with(line, '🤖') THEN 'a' WHEN starts_with(line, '📋') THEN 'm' END AS mark FROM lines),
i AS (SELECT *, count(mark) OVER (PARTITION BY conv_id ORDER BY pos) AS island, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM m),
n AS (SELECT *, sum((mark IS NULL AND trim(line) <> '')::INT) OVER (PARTITION BY conv_id, island ORDER BY pos) AS nth FROM i)
SELECT conv_id, pos, line FROM n WHERE mark IS NOT NULL OR (o = 'a' AND trim(line) <> '' AND nth <= 5)""")
def extract_lines(spark, sf_dir):
    return compact.extract_lines(transcript_lines(spark, sf_dir), "conv_id").select("conv_id", "pos", "line")


@R.add(_PACK.format(source="src AS (SELECT source AS k, lpad(doc_id::VARCHAR, 9, '0') AS o, strlen(text)::BIGINT + 39 AS size FROM documents)", brk="false", sep=0, budget=47900) + """
SELECT k AS source, count(*) AS items, (sum(size) - 39 * count(*))::BIGINT AS total_bytes, CASE WHEN sum(size) - 39 * count(*) + 2100 <= 50000 THEN 1 ELSE max(chunk) + 1 END::BIGINT AS chunks,
  CASE WHEN sum(size) - 39 * count(*) + 2100 <= 50000 THEN 1 ELSE max(chunk) + 2 END::BIGINT AS calls FROM walk GROUP BY k""")
def compact_plan(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.octet_length("text").cast("long").alias("bytes"))
    return compact.plan_calls(items, "source", "name", "bytes", prompt_bytes=2000, budget=50_000)


@R.add("SELECT source, sum(CASE WHEN quality = 1 THEN n_chars END)::BIGINT AS good_chars, sum(toxic)::BIGINT AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def evidence_volume(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("source", F.when(F.col("quality") == 1, F.col("n_chars")).alias("good_chars"), F.col("toxic").cast("long").alias("toxic"), F.lit(1).alias("n"))
    return evidence.volumes(rows, "source", measures=("good_chars", "toxic", "n"))


@R.add("SELECT event_type AS tool, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'm' || user_id % 4 END AS model, count(*) AS sessions, round(sum(value), 4) AS cost_usd FROM events GROUP BY ALL")
def evidence_agents(spark, sf_dir):
    k = F.col("user_id") % 4
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.when(k != 0, F.concat(F.lit("m"), k.cast("string"))).alias("model"), F.lit(1).alias("sessions"), F.col("value").alias("cost_usd"))
    return evidence.agents(e, measures=("sessions", "cost_usd")).withColumn("cost_usd", F.round("cost_usd", 4))


_PARTS = """
p AS (SELECT d.doc_id, source, lang, n_chars, lower(text) AS quote, quality,
  CASE d.doc_id % 8 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'deferred' WHEN 2 THEN 'hardening' WHEN 3 THEN 'rework' WHEN 4 THEN 'first_pass' WHEN 5 THEN 'autonomous_success' ELSE 'unknown' END AS result,
  CASE d.doc_id % 8 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS rank FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _parts(spark, sf_dir):
    k = F.col("doc_id") % 8
    result = F.coalesce(*[F.when(k == n, F.lit(r)) for n, r in enumerate(("abandoned", "deferred", "hardening", "rework", "first_pass", "autonomous_success"))], F.lit("unknown"))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", "source", "lang", "n_chars", F.lower("text").alias("quote"), "quality", result.alias("result"))


@R.add(f"WITH {_PARTS} SELECT lang, sha256(quote) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM p GROUP BY lang, quote")
def evidence_first_wins(spark, sf_dir):
    rows = evidence.first_wins(_parts(spark, sf_dir), ["lang"], F.col("quote"), ["doc_id"], ["doc_id", "source"])
    return rows.withColumn("key", F.sha2("key", 256))


@R.add(f"""
WITH {_PARTS} SELECT lang, source, arg_max(result, rank * 1000000000::BIGINT - doc_id) AS result, sum(n_chars)::BIGINT AS sessions, sha256(arg_min(quote, doc_id) FILTER (quality = 1)) AS notes FROM p GROUP BY lang, source""")
def evidence_worst_wins(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("sessions", F.col("n_chars")).withColumn("notes", F.when(F.col("quality") == 1, F.col("quote")))
    return evidence.worst_wins(rows, ["lang"], "source", ["doc_id"]).withColumn("notes", F.sha2("notes", 256))


@R.add(f"""
WITH {_PARTS}, q AS (SELECT lang, quote, bool_or(coalesce(quality = 0, false)) AS c, min(doc_id) AS o FROM p GROUP BY lang, quote),
n AS (SELECT lang, quote, row_number() OVER (PARTITION BY lang ORDER BY c DESC, CASE WHEN c THEN quote END, o, quote)::INT AS rank FROM q) SELECT lang, sha256(quote) AS quote, rank FROM n WHERE rank <= 10""")
def evidence_quotes(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("c", F.coalesce(F.col("quality") == 0, F.lit(False)))
    return evidence.quotes(rows, ["lang"], "quote", "c", ["doc_id"]).withColumn("quote", F.sha2("quote", 256))


@R.add("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS tags FROM documents GROUP BY lang")
def evidence_union(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.array(F.col("source"), F.lit(" ")).alias("tags"))
    return evidence.string_union(rows, ["lang"], "tags").select("lang", F.array_join("tags", ",").alias("tags"))


def _blocks(spark, sf_dir):
    """Each event as an evidence block of its user's period."""
    i, s = F.col("event_id"), lambda c: c.cast("string")
    name = lambda mark, n, after="": F.concat(F.lit(mark), s(i % n), F.lit(after))
    result = F.element_at(F.array(*map(F.lit, ("rework", "first_pass", "abandoned", "lost", "deferred", "unknown", "hardening"))), (i % 7 + 1).cast("int"))
    kind = F.when(i % 5 == 0, "scope").otherwise("other")
    fields = dict(
        period=F.when(i % 13 == 0, " ").otherwise("2026-01-01"), period_kind=F.when(i % 17 == 0, "month").otherwise("day"), projects=F.array(F.col("event_type"), F.lit(" ")),
        volume=F.struct(F.lit(1).alias("sessions"), F.when(i % 3 > 0, i % 5).alias("user_turns"), (i % 4).alias("corrections"), (i % 2).alias("decisions")),
        agents_used=F.array(F.struct(F.col("event_type").alias("tool"), F.when(i % 4 > 0, name("m", 4)).alias("model"), F.lit(1).alias("sessions"), F.when(i % 6 > 0, i % 7).alias("tokens_in"), F.lit(None).alias("tokens_out"), F.lit(0.25).alias("cost_usd"))),
        instruction_deltas=F.array(F.struct(name(" D", 9, " ").alias("summary"), s(i).alias("target"), F.lit(None).alias("quote"), F.lit(True).alias("codified"))),
        corrections=F.when(i % 3 == 0, F.array(F.struct(kind.alias("type"), F.when(i % 11 == 0, " ").otherwise(name("q", 23)).alias("quote"), s(i).alias("context"), F.lit(None).alias("codified_into")))),
        outcomes=F.array(F.struct(name("U", 3).alias("unit"), result.alias("result"), F.when(i % 2 == 0, F.lit(1)).alias("sessions"), F.when(i % 5 == 0, s(i)).alias("notes"))),
        process_invocations=F.array(name("p", 2)), open_threads=F.array().cast("array<string>"),
        case_study_quotes=F.array(name("z", 4), name("q", 23), name("z", 4)), metrics_ref=F.when(i % 10 == 0, "").when(i % 3 == 0, s(i)), notes=F.when(i % 200 == 0, s(i)),
    )
    e = F.struct(*[v.alias(k) for k, v in fields.items()])
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 5).alias("week"), e.cast(StructType.fromDDL(EVIDENCE)).alias("e"))


@R.add("""
WITH e AS (SELECT *, user_id % 5 AS week, CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 4 THEN 5 WHEN 6 THEN 4 ELSE 0 END AS sev, ['rework', 'first_pass', 'abandoned', 'lost', 'deferred', 'unknown', 'hardening'][(event_id % 7 + 1)::INT] AS result, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'q' || event_id % 23 END AS cq FROM events),
v AS (SELECT week, count(*) AS sessions, sum(CASE WHEN event_id % 3 > 0 THEN event_id % 5 END)::BIGINT AS user_turns, sum(event_id % 2)::BIGINT AS decisions, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS projects, string_agg(DISTINCT 'p' || event_id % 2, ',' ORDER BY 'p' || event_id % 2) AS processes,
  coalesce(min(event_id) FILTER (event_id % 3 = 0 AND event_id % 10 <> 0)::VARCHAR, '') AS metrics_ref, coalesce(string_agg(event_id::VARCHAR, ' | ' ORDER BY event_id) FILTER (event_id % 200 = 0), '') AS notes FROM e GROUP BY week),
a AS (SELECT week, string_agg(t || '/' || m || ':' || n || ':' || i, ',' ORDER BY t, m) AS agents FROM (SELECT week, event_type AS t, CASE WHEN event_id % 4 > 0 THEN 'm' || event_id % 4 ELSE '' END AS m, count(*) AS n, sum(CASE WHEN event_id % 6 > 0 THEN event_id % 7 ELSE 0 END)::BIGINT AS i FROM e GROUP BY ALL) GROUP BY week),
d AS (SELECT week, string_agg(s || ':' || t, ',' ORDER BY s) AS deltas FROM (SELECT week, 'd' || event_id % 9 AS s, min(event_id) AS t FROM e GROUP BY ALL) GROUP BY week),
c AS (SELECT week, string_agg(q || ':' || x, ',' ORDER BY q) AS corrections, count(*) AS n_corrections FROM (SELECT week, cq AS q, min(event_id) AS x FROM e WHERE event_id % 3 = 0 GROUP BY ALL) GROUP BY week),
o AS (SELECT week, string_agg(u || ':' || r || ':' || n || ':' || x, ',' ORDER BY u) AS outcomes FROM (SELECT week, 'U' || event_id % 3 AS u, arg_max(result, sev * 1000000000::BIGINT - event_id) AS r, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n, min(event_id) FILTER (event_id % 5 = 0) AS x FROM e GROUP BY ALL) GROUP BY week),
q AS (SELECT week, quote, bool_or(c) AS c, min(o) AS o FROM (SELECT week, cq AS quote, true AS c, event_id * 10 AS o FROM e WHERE event_id % 3 = 0 UNION ALL SELECT week, 'z' || event_id % 4, false, event_id * 10 FROM e UNION ALL SELECT week, 'q' || event_id % 23, false, event_id * 10 + 1 FROM e) GROUP BY ALL),
r AS (SELECT week, quote, row_number() OVER (PARTITION BY week ORDER BY c DESC, CASE WHEN c THEN quote END, o, quote) AS k FROM q),
s AS (SELECT week, string_agg(quote, ',' ORDER BY k) AS quotes FROM r WHERE k <= 10 GROUP BY week)
SELECT * FROM v JOIN a USING (week) JOIN d USING (week) JOIN c USING (week) JOIN o USING (week) JOIN s USING (week)""")
def evidence_merge(spark, sf_dir):
    m = evidence.merge(_blocks(spark, sf_dir), ["week"], "event_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return m.select(
        "week", "volume.sessions", "volume.user_turns", "volume.decisions", F.col("volume.corrections").alias("n_corrections"), F.array_join("projects", ",").alias("projects"), F.array_join("process_invocations", ",").alias("processes"), text(F.col("metrics_ref")).alias("metrics_ref"), text(F.col("notes")).alias("notes"),
        joined("agents_used", lambda a: F.concat(a["tool"], F.lit("/"), text(a["model"]), F.lit(":"), text(a["sessions"]), F.lit(":"), zero(a["tokens_in"]))).alias("agents"),
        joined("instruction_deltas", lambda d: F.concat(F.lower(F.trim(d["summary"])), F.lit(":"), d["target"])).alias("deltas"), joined("corrections", lambda c: F.concat(c["quote"], F.lit(":"), c["context"])).alias("corrections"),
        joined("outcomes", lambda o: F.concat_ws(":", o["unit"], o["result"], zero(o["sessions"]), o["notes"])).alias("outcomes"), F.array_join("case_study_quotes", ",").alias("quotes"),
    )


@R.add("""
WITH w AS (SELECT event_id, [CASE WHEN event_id % 13 = 0 THEN 'period is empty' END, CASE WHEN event_id % 17 = 0 THEN 'period_kind should be day|week, got month' END, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 1 THEN 'volume.corrections=' || event_id % 4 || ' disagrees with corrections.len()=1' END,
  CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'unknown correction type: scope' END, CASE WHEN event_id % 3 = 0 AND event_id % 11 = 0 THEN 'correction with empty quote' END, CASE WHEN event_id % 7 = 3 THEN 'unknown outcome result: lost' END] AS w FROM events)
SELECT event_id, array_to_string(list_filter(w, lambda x: x IS NOT NULL), '; ') AS warnings FROM w""")
def evidence_warnings(spark, sf_dir):
    return _blocks(spark, sf_dir).select("event_id", F.array_join(evidence.warnings(F.col("e")), "; ").alias("warnings"))


@R.add("""
WITH e AS (SELECT user_id, list(event_type ORDER BY event_id) AS q, list(' D' || event_id % 4 || ' ' ORDER BY event_id) AS d, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id),
a AS (SELECT *, list_filter(q, lambda x: NOT (x = 'error' AND user_id % 3 = 0)) AS q2, list_filter(d, lambda x: NOT (x = ' D3 ' AND user_id % 5 = 0)) AS d2, n + (user_id % 4 = 0)::INT AS n2 FROM e),
r AS (SELECT *, list_filter(q, lambda x: NOT list_contains(q2, x)) AS mq, list_filter(d, lambda x: NOT list_contains(d2, x)) AS md FROM a)
SELECT user_id, round(1 - len(mq) / len(q), 6) AS quote_retention, round(1 - len(md) / len(d), 6) AS delta_retention, len(mq) AS missing_quotes, array_to_string(md, ',') AS missing_deltas, n = n2 AS corrections_match, round(1 - len(mq) / len(q), 9) >= 0.8 AND len(md) = 0 AND n = n2 AS passes FROM r""")
def loss_audit(spark, sf_dir):
    """Lists with repeated entries: what is lost counts as often as it was listed."""
    gathered = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    deltas = lambda x, fold: F.transform(x, lambda r: F.struct((F.lower if fold else F.upper)(F.concat(F.lit(" D"), (r["event_id"] % 4).cast("string"), F.lit(" "))).alias("summary")))
    lost = lambda r: F.struct(F.lit("other").alias("type"), r["event_type"].alias("quote"))
    errors = lambda x: F.transform(F.filter(x, lambda r: r["event_type"] == "error"), lost)

    def block(x, d, c):
        e = F.struct(F.transform(x, lambda r: r["event_type"]).alias("case_study_quotes"), d.alias("instruction_deltas"), c.alias("corrections"), F.struct(F.size(c).alias("corrections")).alias("volume"))
        return gathered.select("user_id", e.alias("e"))

    x, u = F.col("x"), F.col("user_id")
    kept = F.filter(x, lambda r: ~((r["event_type"] == "error") & (u % 3 == 0)))
    kept_deltas = F.filter(x, lambda r: ~((r["event_id"] % 4 == 3) & (u % 5 == 0)))
    more = F.when(u % 4 == 0, F.concat(errors(x), F.array(F.struct(F.lit("other").alias("type"), F.lit("made up").alias("quote"))))).otherwise(errors(x))
    out = evidence.loss_audit(block(x, deltas(x, False), errors(x)), block(kept, deltas(kept_deltas, True), more), "user_id")
    return out.select("user_id", F.round("quote_retention", 6).alias("quote_retention"), F.round("delta_retention", 6).alias("delta_retention"), F.size("missing_quotes").cast("long").alias("missing_quotes"), F.array_join("missing_deltas", ",").alias("missing_deltas"), "corrections_match", "passes")


@R.add("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def loss_missing(spark, sf_dir):
    return evidence.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@R.add("""
SELECT event_id, to_timestamp(event_id * 1000)::TIMESTAMP AS u, ts AS rfc, ts AS epoch FROM events""")
def timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    uuid = F.concat(F.lpad(F.lower(F.hex(F.col("event_id") * 1_000_000)), 12, "0"), F.lit("-7000-8000-000000000000"))
    uuid = F.concat(F.substring(uuid, 1, 8), F.lit("-"), F.substr(uuid, F.lit(9)))
    rfc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")
    ntz = lambda c: c.cast("timestamp_ntz")
    return e.select("event_id", ntz(timeutil.uuid7_time(uuid)).alias("u"), ntz(timeutil.any_timestamp(rfc)).alias("rfc"), ntz(F.coalesce(timeutil.any_timestamp(F.lit("nonsense")), F.timestamp_micros((epoch * 1_000_000).cast("long")))).alias("epoch"))


@R.add("SELECT event_id, printf('evt-%06d', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS name, sha256('user' || user_id) AS user_hash FROM events")
def event_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", digests.event_id(n).alias("name"), digests.text_hash(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("user_hash"))




@R.add("""
SELECT path FROM (SELECT 'd' || doc_id AS path FROM documents WHERE lang = 'en' UNION SELECT 'd' || doc_id FROM labels)""")
def dedupe_sources(spark, sf_dir):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    return scan.united(table(spark, sf_dir, "documents").where("lang = 'en'").select(path), table(spark, sf_dir, "labels").select(path))


@R.add("""
WITH i AS (SELECT source AS period, doc_id, strlen(text) AS n, strlen(text) + length('d' || lpad(doc_id::VARCHAR, 9, '0')) + 30 AS item, text FROM documents WHERE text <> '' AND n_chars < 900),
s AS (SELECT period, sum(n) AS total, count(*) AS items FROM i GROUP BY period)
SELECT period, items, (total + 106 > 4000) AS chunked, total::BIGINT AS bytes FROM s""")
def assembled_inputs(spark, sf_dir):
    """Inputs of a model, within the budget unless one item alone exceeds it: every item is in one of them, whole and once."""
    d = table(spark, sf_dir, "documents").where("text <> '' AND n_chars < 900").select(F.col("source").alias("period"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), "text")
    made = calls.assembled(d, "period", "name", "text", "merge!", 4000)
    within = F.when((F.octet_length("input") <= 4200) | (F.col("n") == 1), 0).otherwise(1)
    rows = made.withColumn("n", F.regexp_count("input", F.lit(r"--- end of d\d{9} ---\n")))
    rest = F.regexp_replace(F.regexp_replace("input", r"\n--- end of d\d{9} ---\n\n", ""), r"\Amerge!\n\n=== [^\n]* ===\n\n|=== end ===\n\z", "")
    per = rows.withColumn("bytes", F.octet_length(rest)).groupBy("period").agg(F.sum("n").cast("long").alias("items"), (F.max("chunks") > 1).alias("chunked"), F.sum("bytes").alias("bytes"), F.sum(within).alias("beyond"))
    return per.where("beyond = 0").drop("beyond")


@R.add("""
WITH r AS (SELECT source AS day, doc_id % 7 AS chunk, doc_id % 11 <> 0 AS ok FROM documents), c AS (SELECT day, chunk, bool_or(ok) AS done FROM r GROUP BY ALL)
SELECT day, 7::BIGINT AS total_chunks, count(*) FILTER (done) AS completed_chunks, CASE WHEN count(*) FILTER (done) = 7 THEN 'complete' WHEN count(*) FILTER (NOT done) > 0 THEN 'failed' ELSE 'partial' END AS status, CASE WHEN count(*) FILTER (NOT done) > 0 THEN 'timeout' ELSE '' END AS failure FROM c GROUP BY day""")
def compact_status(spark, sf_dir):
    """Status of a period from the results of its chunks, of which some were tried again."""
    d, ok = table(spark, sf_dir, "documents"), F.col("doc_id") % 11 != 0
    event = F.struct(F.lit(0).alias("retry_count"), F.when(ok, "success").otherwise("failure").alias("outcome"), F.when(~ok, "timeout").alias("failure_class"), F.lit(None).cast("string").alias("detail"), F.lit(1).cast("long").alias("elapsed_ms"))
    results = d.select(F.col("source").alias("day"), (F.col("doc_id") % 7).cast("int").alias("chunk"), F.lit(7).cast("long").alias("chunks"), F.when(ok, "text").alias("output"), F.array(event).alias("events"))
    return calls.status(results, "day").select("day", "total_chunks", "completed_chunks", "status", F.coalesce("failure_class", F.lit("")).alias("failure"))
