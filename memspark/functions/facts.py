"""Fact extraction by patterns (L3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import tag

# Pattern, kind, key ({tag}: from the value, {0}: from the first group), confidence.
PATTERNS = [
    (r"(?:i|I)\s+(?:like|love|enjoy|prefer|adore)\s+(.+?)(?:\.|,|!|$)", "preference", "pref:{tag}", 0.8),
    (r"(?:my name is|i'm|i am)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "identity", "identity:name", 0.95),
    (r"(?:i work (?:at|for)|i'm working (?:at|for))\s+(.+?)(?:\.|,|!|$)", "professional", "prof:company", 0.85),
    (r"(?:i'm a|i am a|i work as a?)\s+(.+?)(?:\.|,|!|$)", "professional", "prof:role", 0.85),
    (r"(?:i (?:live|reside) in|i'm (?:from|based in))\s+(.+?)(?:\.|,|!|$)", "identity", "identity:location", 0.9),
    (r"my (?:fav(?:ou?rite)?)\s+(\w+)\s+is\s+(.+?)(?:\.|,|!|$)", "preference", "pref:{0}", 0.85),
    (r"(?:i'm|i am)\s+(?:learning|studying)\s+(.+?)(?:\.|,|!|$)", "goal", "goal:learning", 0.7),
    (r"(?:i want to|i plan to|my goal is to|i'd like to)\s+(.+?)(?:\.|,|!|$)", "goal", "goal:aspiration", 0.7),
    (r"(?:i have|i've got)\s+(?:a |an )?(.+?)(?:\.|,|!|$)", "fact", "fact:possession", 0.7),
    (r"my\s+(\w+)\s+is\s+(.+?)(?:\.|,|!|$)", "fact", "fact:{0}", 0.65),
]
PREFIXES = {"preference": "The user likes/prefers: ", "goal": "User goal: ", "fact": "The user mentioned: "}


# case and classes of all letters, `.` and `$` know only line feeds
FLAGS = "(?idU)"
SPACE = r"[\s\x1c-\x1f]"


def stripped(text):
    """text without white space at its ends."""
    return F.regexp_replace(text, f"{FLAGS}^{SPACE}+|{SPACE}+\\z", "")


def extract_facts(texts: DataFrame, ident: str = "id", column: str = "content") -> DataFrame:
    """One row for each match of each pattern with a value of 2 to 100 characters, which is stripped
    of white space and then of .,!? at its end: id, rule, place, memory_key, content, memory_type,
    confidence."""
    branches = []
    for rule, (pattern, kind, key, confidence) in enumerate(PATTERNS):
        several = "{0}" in key
        hits = F.expr(f"regexp_extract_all({column}, r\"{FLAGS}{pattern}\", {2 if several else 1})")
        firsts = F.expr(f"regexp_extract_all({column}, r\"{FLAGS}{pattern}\", 1)")
        rows = texts.where(F.col(column).rlike(FLAGS + pattern)).select(ident, F.posexplode(F.arrays_zip(firsts.alias("first"), hits.alias("value"))).alias("place", "m"))
        value = F.regexp_replace(stripped(F.col("m.value")), r"[.,!?]+\z", "")
        name = F.concat(F.lit(key.split(":")[0] + ":"), tag(stripped(F.col("m.first"))) if several else tag(value)) if "{" in key else F.lit(key)
        label = F.element_at(F.split(name, ":"), 2)
        lead = F.lit(PREFIXES[kind]) if kind in PREFIXES else F.concat(F.lit("User info — " if kind == "identity" else "Professional — "), label, F.lit(": "))
        branches.append(
            rows.select(
                ident,
                F.lit(rule).alias("rule"),
                "place",
                name.alias("memory_key"),
                F.concat(lead, value).alias("content"),
                F.lit("semantic" if kind in ("preference", "identity", "fact") else "episodic").alias("memory_type"),
                F.lit(confidence).alias("confidence"),
                F.length(value).alias("_size"),
            ).where("_size between 2 and 100")
        )
    return reduce(DataFrame.unionByName, branches).drop("_size")
