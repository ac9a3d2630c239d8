"""Kinds, summaries, metrics, prices and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlark.functions import pricing, text, timeutil
from loomlark.operators import kinds, metrics, summary
from loomlark.plans.registry import Registry, table

R = Registry()

_FIRST = """
first AS (
  SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id),
prompt AS (
  SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'You are a reviewer. ' || t WHEN 1 THEN t || ' Output format: JSON. Report only.'
    WHEN 2 THEN t || ' specifically' ELSE t END AS t FROM first)"""


def first_prompts(spark, sf_dir):
    """First user text of each conversation, with injected phrases, as the raw table has hardly any."""
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    k = F.col("conv_id") % 5
    t = F.col("t")
    injected = F.when(k == 0, F.concat(F.lit("You are a reviewer. "), t)).when(k == 1, F.concat(t, F.lit(" Output format: JSON. Report only."))).when(k == 2, F.concat(t, F.lit(" specifically"))).otherwise(t)
    return first.select("conv_id", injected.alias("t"))


_IN = lambda words: "(" + " + ".join(f"(contains(l, '{w}'))::INT" for w in words) + ")"


@R.add(f"""
WITH {_FIRST},
stats AS (SELECT conv_id, count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER (role = 'assistant') AS asst_msgs FROM conversations GROUP BY conv_id),
low AS (SELECT s.conv_id, user_msgs, asst_msgs, trim(t) AS t, lower(trim(t)) AS l FROM stats s LEFT JOIN prompt USING (conv_id))
SELECT conv_id, user_msgs, asst_msgs,
  CASE WHEN t IS NULL OR t = '' THEN 'uncertain'
    WHEN starts_with(l, 'you are ') OR starts_with(l, 'your job is ') THEN 'delegated'
    WHEN {_IN(kinds.MARKERS)} >= 2 THEN 'delegated'
    WHEN strlen(t) > 240 AND {_IN(kinds.LONG_WORDS)} > 0 THEN 'delegated' ELSE 'human' END AS kind
FROM low""")
def session_kind(spark, sf_dir):
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    stats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(count("user").alias("user_msgs"), count("assistant").alias("asst_msgs"))
    return stats.join(first_prompts(spark, sf_dir), "conv_id", "left").select("conv_id", "user_msgs", "asst_msgs", kinds.session_kind(F.col("t")).alias("kind"))


@R.add("""
WITH facts AS (
  SELECT 'conversation' AS grain, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'user-day', count(*) FILTER (event_type = 'purchase'), count(*) FILTER (event_type IN ('click', 'view')) FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT grain, CASE WHEN u > 2 THEN 'interactive' WHEN a > 2 THEN 'agentic' ELSE 'abandoned' END AS kind, count(*) AS n FROM facts GROUP BY ALL""")
def transcript_kind(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(count(F.col("role") == "user").alias("u"), count(F.col("role") == "assistant").alias("a")).select(F.lit("conversation").alias("grain"), "u", "a")
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(count(F.col("event_type") == "purchase").alias("u"), count(F.col("event_type").isin("click", "view")).alias("a")).select(F.lit("user-day").alias("grain"), "u", "a")
    return a.unionByName(e).groupBy("grain", kinds.transcript_kind(F.col("u"), F.col("a")).alias("kind")).agg(F.count("*").alias("n"))


@R.add("""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS tool, o_totalprice FROM orders)
SELECT CASE WHEN grouping(month) = 1 THEN 'Total' ELSE month END AS month, CASE WHEN grouping(tool) = 1 THEN 'Total' ELSE tool END AS tool,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY GROUPING SETS ((month, tool), (month), (tool), ())""")
def summary_month_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("tool"), "o_totalprice")
    return summary.by_month_and_tool(o, "month", "tool", F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def summary_month_wide(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    return summary.pivoted(o, "month", "o_orderpriority", _PRIORITIES, F.count(F.lit(1))).fillna(0)


@R.add("""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, value FROM events)
SELECT CASE WHEN grouping(day) = 1 THEN 'Total' ELSE day END AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS value
FROM e GROUP BY ROLLUP (day)""")
def summary_daily_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    return summary.by_key(e, "day", F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.round(F.sum("value"), 4).alias("value"))


@R.add("""
WITH p AS (SELECT CASE WHEN p_size % 10 = 0 THEN 'unknown' ELSE p_type || '/' || p_brand END AS project, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN grouping(project) = 1 THEN 'Total' ELSE project END AS project, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, round(sum(l_extendedprice), 2) AS price FROM p GROUP BY ROLLUP (project)""")
def summary_project_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, "").otherwise(text.shorten_project(F.concat(F.lit("/home/work/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/")))).alias("path"))
    p = p.select("p_partkey", F.replace("path", F.lit("work/"), F.lit("")).alias("project"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return summary.by_key(rows, "project", F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), missing="unknown")


_BUCKETS = """
WITH e AS (SELECT {period} AS period, event_type, user_id % 3 AS project, value FROM events {where})
SELECT period, 'total' AS dimension, 'all' AS bucket, count(*) AS n, round(sum(value), 4) AS value FROM e GROUP BY period
UNION ALL SELECT period, 'tool', event_type, count(*), round(sum(value), 4) FROM e GROUP BY period, event_type
UNION ALL SELECT period, 'project', project::VARCHAR, count(*), round(sum(value), 4) FROM e GROUP BY period, project"""


def _event_facts(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))


def _measures():
    return {"n": F.count("*"), "value": F.round(F.sum("value"), 4)}


@R.add(_BUCKETS.format(period="strftime(ts, '%Y-%m-%d')", where="WHERE CAST(ts AS DATE) = DATE '2024-01-10'"))
def metrics_day(spark, sf_dir):
    return metrics.day_metrics(_event_facts(spark, sf_dir), "date", {"tool": F.col("event_type"), "project": F.col("user_id") % 3}, _measures(), "2024-01-10")


@R.add(_BUCKETS.format(period="strftime(ts, '%G-W%V')", where=""))
def metrics_week(spark, sf_dir):
    return metrics.week_metrics(_event_facts(spark, sf_dir), "date", {"tool": F.col("event_type"), "project": F.col("user_id") % 3}, _measures())


@R.add("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, strftime(day, '%G-W%V') AS week, CAST(date_trunc('week', day) AS DATE) AS monday, CAST(date_trunc('week', day) AS DATE) + 6 AS sunday FROM d""")
def iso_week_ids(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    week = timeutil.iso_week(F.col("day"))
    return d.select("day", week.alias("week"), timeutil.monday(F.col("day")).alias("monday"), F.element_at(timeutil.week_days(week), 7).alias("sunday"))


#: Patterns over part names for the tests of first match.
PART_PRICES = (("green", 2.0, 4.0, 0.5, 0.25), ("re", 1.0, 3.0, 0.0, 0.0), ("blue", 0.5, 1.5, 0.0, 0.0), ("l", 0.25, 0.75, 0.125, 0.0))
_PART_CASE = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{p[0]}') THEN {k}" for k, p in enumerate(PART_PRICES)) + " END"
_PART_RATE = lambda f: "CASE " + " ".join(f"WHEN contains(lower(p_name), '{p[0]}') THEN {p[f]}" for p in PART_PRICES) + " END"


@R.add(f"SELECT p_partkey, p_name, coalesce({_PART_CASE}, -1) AS rank, coalesce({_PART_RATE(1)}, -1)::DOUBLE AS input, coalesce({_PART_RATE(2)}, -1)::DOUBLE AS output FROM part")
def price_first_match(spark, sf_dir):
    price = pricing.price_of(F.col("p_name"), PART_PRICES)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", *[F.coalesce(price[f], F.lit(-1)).alias(f) for f in ("rank", "input", "output")])


@R.add(f"""
SELECT l_returnflag, count(*) AS n, count(CASE WHEN {_PART_CASE} IS NULL THEN 1 END) AS unknown,
  round(sum(l_quantity * ({_PART_RATE(1)}) / 1e6 + l_linenumber * ({_PART_RATE(2)}) / 1e6), 6) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""")
def estimate_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_linenumber").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cost = pricing.estimate_cost(F.col("p_name"), F.col("l_quantity"), F.col("l_linenumber"), prices=PART_PRICES)
    return rows.withColumn("c", cost).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(F.when(F.col("c").isNull(), 1)).alias("unknown"), F.round(F.sum("c"), 6).alias("cost"))


@R.add("""
WITH m(k, model) AS (VALUES (0, 'claude-opus-4-5-20251101'), (1, 'gpt-5.5'), (2, 'o3-mini-high'), (3, 'deepseek-v3.1'), (4, 'Kimi-K2-Thinking'), (5, 'none'), (6, 'gpt-5-nano')),
  p(k, i, o) AS (VALUES (0, 5.0, 25.0), (1, 1.25, 10.0), (2, 1.10, 4.40), (3, 0.27, 1.10), (4, 0.60, 2.50), (6, 0.05, 0.40))
SELECT model, count(*) AS n, round(sum(o_orderkey % 1000 * i / 1e6 + o_custkey % 1000 * o / 1e6), 6) AS cost FROM orders JOIN m ON o_orderkey % 7 = m.k LEFT JOIN p USING (k) GROUP BY model""")
def model_prices(spark, sf_dir):
    models = ["claude-opus-4-5-20251101", "gpt-5.5", "o3-mini-high", "deepseek-v3.1", "Kimi-K2-Thinking", "none", "gpt-5-nano"]
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.element_at(F.array(*map(F.lit, models)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("model"))
    cost = pricing.estimate_cost(F.col("model"), F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000)
    return o.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@R.add("""
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE n::VARCHAR END AS tokens
FROM (SELECT o_orderkey, o_orderkey * 137 AS n FROM orders)""")
def format_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_tokens(F.col("o_orderkey") * 137).alias("tokens"))


@R.add("""
SELECT o_orderkey, CASE WHEN c < 0.005 THEN '<$0.01' WHEN c < 100 THEN printf('$%.2f', c) ELSE printf('$%.0f', c) END AS cost
FROM (SELECT o_orderkey, o_totalprice * o_totalprice / 1e8 + 0.0011 AS c FROM orders)""")
def format_cost(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_cost(F.col("o_totalprice") * F.col("o_totalprice") / 1e8 + 0.0011).alias("cost"))


@R.add("""
WITH d AS (SELECT event_id, event_id * 13 - 500 AS s FROM events)
SELECT event_id, CASE WHEN s <= 0 THEN '-' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s % 3600 // 60) || 'm' END AS short,
  CASE WHEN s < 0 THEN '0s' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS detailed FROM d""")
def format_duration(spark, sf_dir):
    s = F.col("event_id") * 13 - 500
    return table(spark, sf_dir, "events").select("event_id", text.format_duration(s).alias("short"), text.format_duration(s, detailed=True).alias("detailed"))


@R.add("""
WITH d AS (SELECT doc_id, n_chars, n_chars / 1000.0 AS k FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trunc(printf('%.3f', k)::DOUBLE * 1000.0)::BIGINT WHEN 1 THEN trunc(printf('%.3f', k)::DOUBLE * 1000000.0)::BIGINT WHEN 2 THEN n_chars ELSE 0 END AS tokens,
  n_chars % 100 * 3600 + n_chars % 60 * 60 + 7 AS seconds FROM d""")
def parse_tokens(spark, sf_dir):
    k = F.format_string("%.3f", F.col("n_chars") / 1000)
    m = F.col("doc_id") % 4
    written = F.when(m == 0, F.concat(F.lit(" "), k, F.lit("K"))).when(m == 1, F.concat(k, F.lit("M "))).when(m == 2, F.col("n_chars").cast("string")).otherwise("1.5x")
    duration = F.format_string("%dh %dm 7s nonsense", F.col("n_chars") % 100, F.col("n_chars") % 60)
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_token_value(written).alias("tokens"), text.parse_duration(duration).alias("seconds"))


@R.add("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'fable-' || (p_size % 9) || '.5' WHEN 1 THEN 'synthetic' ELSE 'gpt-' || p_size END AS short,
  CASE p_partkey % 3 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN p_type ELSE p_brand END AS combined FROM part""")
def model_names(spark, sf_dir):
    m = F.col("p_partkey") % 3
    model = F.when(m == 0, F.format_string("claude-fable-%d-5-20250101", F.col("p_size") % 9)).when(m == 1, "<synthetic>").otherwise(F.concat(F.lit("gpt-"), F.col("p_size").cast("string")))
    combined = text.combine_model(F.when(m == 1, "").otherwise(F.col("p_brand")), F.when(m == 2, F.lit(None)).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", text.shorten_model(model).alias("short"), combined.alias("combined"))
