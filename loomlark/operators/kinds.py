"""Kinds of sessions and transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlark.functions.text import trimmed

#: Openings of delegated prompts (fixed values).
PREFIXES = ("you are ", "your job is ", "you are a ", "you are an ")
#: Phrases of which two mark a delegated prompt (fixed values).
MARKERS = (
    "do not modify", "do not change files", "do not execute", "focus on ", "output format", "provide a report", "report only",
    "analyze as data", "do not modify code", "just analyze", "just review", "do not write code", "proceed to implementation", "limit test updates",
)
#: Phrases that mark a long prompt as delegated (fixed values).
LONG_WORDS = ("identify where", "provide a diagram", "specifically", "pinpoint", "list ")
LONG_BYTES = 240


def session_kind(first_user_text: Column) -> Column:
    """human, delegated or uncertain, from the first user text that is not blank (null: none)."""
    t = trimmed(first_user_text)
    low = F.lower(t)
    has = lambda words: F.array(*map(F.lit, words))
    opens = F.exists(has(PREFIXES), lambda p: F.startswith(low, p))
    marks = F.size(F.filter(has(MARKERS), lambda m: F.contains(low, m)))
    long = (F.octet_length(t) > LONG_BYTES) & F.exists(has(LONG_WORDS), lambda w: F.contains(low, w))
    return F.when(t.isNull() | (t == ""), "uncertain").when(opens | (marks >= 2) | long, "delegated").otherwise("human")


def transcript_kind(user_msgs: Column, asst_msgs: Column) -> Column:
    return F.when(user_msgs > 2, "interactive").when(asst_msgs > 2, "agentic").otherwise("abandoned")
