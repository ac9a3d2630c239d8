"""Text functions as Column expressions. Everything here stays inside whole-stage code generation or
Catalyst's higher-order functions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_last_newline(c: Column) -> Column:
    return F.regexp_replace(c, r"\n\z", "")


def lines(c: Column) -> Column:
    """Lines of a text: a final empty line and carriage returns before line feeds are dropped."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(without_last_newline(c), r"\r?\n"))


def shorten_project(path: Column) -> Column:
    """The last three components of a path; separators of either kind."""
    flat = F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
    parts = F.split(flat, "/")
    return F.when(F.size(parts) <= 3, flat).otherwise(F.array_join(F.slice(parts, -3, 3), "/"))


def _number(token: Column, unit: str) -> Column:
    """The integer before ``unit``, else 0."""
    return F.coalesce(F.regexp_extract(token, rf"^([+-]?\d{{1,18}}){unit}$", 1).try_cast("long"), F.lit(0).cast("long"))


def parse_duration(c: Column) -> Column:
    """Seconds of ``1h 4m 5s``: the sum over white-space-separated tokens; a bad token counts 0."""
    tokens = F.split(trimmed(c), r"(?U)\s+")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda s, t: s + _number(t, "h") * 3600 + _number(t, "m") * 60 + _number(t, "s"))


def parse_token_value(c: Column, lower_units: bool = False) -> Column:
    """``1.2K``, ``3.4M`` or a plain integer, truncated; anything else is 0."""
    t = trimmed(c)
    k, m = ("[Kk]", "[Mm]") if lower_units else ("K", "M")
    scaled = lambda unit, by: (F.coalesce(F.regexp_extract(t, rf"^(.*){unit}$", 1).try_cast("double"), F.lit(0.0)) * by).cast("long")
    return F.when(t.rlike(rf"{m}$"), scaled(m, 1_000_000.0)).when(t.rlike(rf"{k}$"), scaled(k, 1_000.0)).otherwise(F.coalesce(t.try_cast("long"), F.lit(0).cast("long")))


def _decimals(x: Column, places: int) -> Column:
    return F.call_function("format_number", x, F.lit("0" + ("." + "0" * places if places else "")))


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(_decimals(n / 1_000_000, 1), F.lit("M"))).when(n >= 1_000, F.concat(_decimals(n / 1_000, 1), F.lit("K"))).otherwise(n.cast("string"))


def format_cost(cost: Column) -> Column:
    return F.when(cost < 0.005, "<$0.01").when(cost < 100, F.concat(F.lit("$"), _decimals(cost, 2))).otherwise(F.concat(F.lit("$"), _decimals(cost, 0)))


def format_duration(seconds: Column, detailed: bool = False) -> Column:
    """``2h 5m`` or ``7m``; ``-`` if there is none. ``detailed`` shows seconds below a minute and ``0s`` if negative."""
    h, m, s = (F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), seconds % 60)
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    both = F.concat_ws(" ", part(h, "h"), part(m, "m"))
    if detailed:
        return F.when(seconds < 0, "0s").when(h > 0, both).when(m > 0, part(m, "m")).otherwise(part(s, "s"))
    return F.when(seconds <= 0, "-").when(h > 0, both).otherwise(part(m, "m"))


def shorten_model(model: Column) -> Column:
    """Family and version of a dated model name."""
    pattern = r"^claude-([^-]*)-(\d{1,9})-(\d{1,9})(?:-.*)?$"
    return F.when(model == "<synthetic>", "synthetic").otherwise(F.regexp_replace(model, pattern, "$1-$2.$3"))


def combine_model(provider: Column, model: Column) -> Column:
    return F.concat_ws("/", F.nullif(provider, F.lit("")), F.nullif(model, F.lit("")))


def truncate_line(c: Column, most: int) -> Column:
    """At most ``most`` characters, with ``...`` after a cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes: of the characters, those whose running
    length fits. A text within the limit is passed on as it is."""
    head = F.substring(c, 1, most)
    fit = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda s, ch: F.when(s["bytes"] + F.octet_length(ch) <= most, F.struct((s["bytes"] + F.octet_length(ch)).alias("bytes"), (s["chars"] + F.length(ch)).alias("chars"))).otherwise(F.struct(F.lit(most + 1).alias("bytes"), s["chars"].alias("chars"))),
        lambda s: s["chars"],
    )
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substr(c, F.lit(1), fit))


def clean_user_text(c: Column) -> Column:
    """Without injected context elements and file mentions."""
    out = F.regexp_replace(c, r"""(?s)<context ref="[^"]*">.*?</context>\s*""", "")
    return trimmed(F.regexp_replace(out, r"\[@[^\]]*\]\([^)]*\)\s*", ""))


#: Openings of texts that a tool injects (fixed values).
INJECTED_TAGS = ("<user_info>", "<git_status>", "<rules>", "<agent_skills>")


def user_query(c: Column) -> Column:
    """The inside of ``<user_query>``; null for injected context; else the trimmed text."""
    inner = F.regexp_extract(c, r"(?s)<user_query>(.*?)</user_query>", 1)
    t = trimmed(c)
    injected = F.exists(F.array(*map(F.lit, INJECTED_TAGS)), lambda tag: F.startswith(t, tag))
    return F.when(c.contains("<user_query>"), F.nullif(trimmed(inner), F.lit(""))).when(injected | (t == ""), F.lit(None)).otherwise(t)


def queue_summary(c: Column) -> Column:
    """The inside of ``<summary>``, else the first 100 bytes."""
    inner = F.regexp_extract(c, r"(?s)<summary>(.*?)</summary>", 1)
    return F.when(c.rlike(r"(?s)<summary>.*?</summary>"), trimmed(inner)).otherwise(truncate_bytes(trimmed(c), 100))


def output_failed(c: Column) -> Column:
    """An exit code that is stated and not 0, on any line of a tool's output."""
    return c.rlike(r"(?m)^[ \t]*(?:Exit code:|last_exit_code:)[ \t]*(?!0?[ \t\r]*$)\S")


def shell_reads(command: Column) -> Column:
    """Paths that a shell command reads: the first use of each reading verb."""
    found = [F.regexp_extract(command, rf"""(?s)^.*?{verb} ['"]*([^\s'"|>]*)""", 1) for verb in ("cat", "less", "head", "tail", "bat")]
    return F.array_distinct(F.filter(F.array(*found), lambda p: p != ""))


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded, plus signs and invalid escapes kept as they are."""
    return F.try_url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def slug_to_path(slug: Column) -> Column:
    return F.concat(F.lit("/"), F.translate(slug, "-", "/"))


def slug(c: Column) -> Column:
    """ASCII letters, digits, ``-`` and ``_`` in lower case, others ``-``, trimmed of ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "-")), "^-+", ""), "-+$", "")


#: Where an embedded path may begin, in the order in which they are cut (fixed values).
PATH_MARKERS = ("/Users/", "/Volumes/", "/var/", "/tmp/", "/opt/", "/usr/", "~/", "./", "../")


def scrub_paths(line: Column) -> Column:
    """A line without link targets, path tokens and embedded paths; white space becomes single spaces."""
    bare = F.regexp_replace(line, r"\]\([^)]*\)", "")
    tokens = F.filter(F.split(bare, r"(?U)\s+"), lambda t: t != "")
    edge = r"""["'`<>()\[\]{},;:]"""
    tokens = F.filter(tokens, lambda t: ~t.rlike(rf"^{edge}*(?:/|~/|\./|\.\./)"))

    def cut(t: Column) -> Column:
        for marker in PATH_MARKERS:
            t = F.regexp_replace(t, rf"""\Q{marker}\E[^"'`<>()\[\]{{}},;\s]*""", "")
        return t

    # only a token with a slash can hold a path
    cleaned = F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("/")), cut(t)).otherwise(t))
    # leading tokens that become empty leave no space
    return F.regexp_replace(F.array_join(cleaned, " "), "^ +", "")


#: Prefixes of transcript lines (fixed values).
META, USER, ASSISTANT, TOOL_OK, TOOL_FAILED, QUEUE = "\U0001f4cb", "\U0001f464", "\U0001f916", "✅", "❌", "⏳"


def speaker_of_line(line: Column) -> Column:
    """user, assistant, tool or other by the line's prefix; null without one."""
    starts = lambda p: F.startswith(line, F.lit(p))
    return F.when(starts(USER), "user").when(starts(ASSISTANT), "assistant").when(starts(TOOL_OK) | starts(TOOL_FAILED), "tool").when(starts(META) | starts(QUEUE), "other")


#: Names of tools as they end a session's file name, longest first (fixed values).
TOOL_SUFFIXES = ("claude-chat", "claude", "codex", "hermes", "opencode", "pi", "grok", "cursor", "kimi")


def tool_suffix(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, f"-({'|'.join(TOOL_SUFFIXES)})$", 1), F.lit(""))
