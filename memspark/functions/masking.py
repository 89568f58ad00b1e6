"""Masking of personal data."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of the server and of the embedded store, in the order that breaks ties.
SERVER = {
    "ssn": (r"\b\d{3}[-–]\d{2}[-–]\d{4}\b", "[SSN]"),
    "credit_card": (r"\b(?:\d{4}[-– ]?){3}\d{1,4}\b", "[CREDIT_CARD]"),
    "email": (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    "phone": (r"(?<!\d)(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)", "[PHONE]"),
    "ip_address": (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_ADDRESS]"),
    "us_passport": (r"\b[A-Z]\d{8}\b", "[PASSPORT]"),
    "date_of_birth": (r"(?i)(?:dob|date\s*of\s*birth|born(?:\s+on)?)\s*[:=]?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})", "[DOB]"),
}
EMBEDDED = {
    "email": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    "phone": (r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}", "[PHONE]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    "credit_card": (r"\b(?:\d[ -]*?){13,19}\b", "[CREDIT_CARD]"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
    "us_passport": (r"\b[A-Z]\d{8}\b", "[PASSPORT]"),
    "date_of_birth": (r"(?i)(?:dob|date of birth|birth\s*date)\s*[:\-]?\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", "[DOB]"),
}
# what any match of all patterns of a set holds: rows without it needn't go to Python
LOOSE = {
    "server": r"(?U)@|\d{3}[-–]\d{2}|\d{4}[-– ]?\d{4}|\d{3}\)?[-.\s\x1c-\x1f]?\d{3}|\d\.\d|[A-Z]\d{8}|\d[/\-]\d",
    "embedded": r"(?U)@|\d{3}|\d[ -]+\d|\d\.\d|\d[/\-]\d",
}
SLICE = 64  # payloads that are decoded at once
FOUND = "struct<masked:string, detections:array<struct<pattern:string, begin:int, end:int>>>"


def custom(config: str | None) -> dict[str, tuple[str, str]]:
    """Patterns of a JSON list of {name, regex[, token]}; what can't be read is left out."""
    made = {}
    try:
        entries = json.loads(config or "[]")
    except ValueError:
        return made
    for e in entries if isinstance(entries, list) else []:
        try:
            re.compile(e["regex"])
            made[e["name"]] = (e["regex"], e.get("token") or f"[{e['name'].upper()}]")
        except (KeyError, TypeError, AttributeError, re.error):
            continue
    return made


def masker(patterns: dict[str, tuple[str, str]]) -> Callable[[str], tuple[str, list[tuple[str, int, int]]]]:
    """All matches of all patterns; of overlapping ones the first, then the longer, then the earlier
    pattern stays and becomes its token."""
    compiled = [(name, re.compile(p), token) for name, (p, token) in patterns.items()]

    def mask_one(text: str):
        spans = sorted(((m.start(), -m.end(), k) for k, (_, p, _) in enumerate(compiled) for m in p.finditer(text) if m.end() > m.start()))
        out, kept, at = [], [], 0
        for begin, end, k in spans:
            if begin >= at:
                out += [text[at:begin], compiled[k][2]]
                at = -end
                kept.append((compiled[k][0], begin, at))
        return "".join([*out, text[at:]]), kept

    return mask_one


def mask_column(patterns: dict[str, tuple[str, str]] = SERVER):
    """An Arrow UDF from text to struct(masked, detections); null stays null."""

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        one = masker(patterns)
        rows = [(None, None) if t is None else one(t) for t in texts]
        return pd.DataFrame({"masked": [r[0] for r in rows], "detections": [None if r[1] is None else [{"pattern": n, "begin": a, "end": b} for n, a, b in r[1]] for r in rows]})

    return run


def mask(df: DataFrame, column: str, patterns: dict[str, tuple[str, str]] = SERVER) -> DataFrame:
    """df with the column masked and `detections`, what was found (P1, P5).  Of the fixed sets, only
    texts that hold what every match needs go to Python; others pass as they are."""
    loose = LOOSE.get("server" if patterns == SERVER else "embedded" if patterns == EMBEDDED else "")
    text = F.col(column)
    hit = text.rlike(loose) if loose else text.isNotNull()
    found = df.withColumn("_hit", hit).withColumn("_found", mask_column(patterns)(F.when(F.col("_hit"), text)))
    none = F.when(text.isNotNull(), F.array().cast("array<struct<pattern:string,begin:int,end:int>>"))
    detections = F.when(F.col("_hit"), F.col("_found.detections")).otherwise(none)
    return found.withColumn("detections", detections).withColumn(column, F.when(F.col("_hit"), F.col("_found.masked")).otherwise(text)).drop("_found", "_hit")


def mask_payload(df: DataFrame, column: str, fields: list[str] | None = None, patterns: dict[str, tuple[str, str]] = SERVER) -> DataFrame:
    """Top-level string values of a JSON object masked, all or those of `fields`."""

    @F.arrow_udf("string")
    def run(payloads: pa.Array) -> pa.Array:
        one = masker(patterns)

        def each(raw):
            try:
                data = json.loads(raw)
            except (TypeError, ValueError):
                return raw
            if not isinstance(data, dict):
                return raw
            return json.dumps({k: one(v)[0] if isinstance(v, str) and (fields is None or k in fields) else v for k, v in data.items()}, ensure_ascii=False)

        # a few payloads at a time are Python objects, whatever the size of a batch
        parts = [pa.array(map(each, payloads.slice(k, SLICE).to_pylist()), pa.string()) for k in range(0, len(payloads), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(column, run(column))


def masking_audit(masked: DataFrame, original: str, entity_type: str, entity_id: str) -> DataFrame:
    """An audit row of each row with detections (P3, P6): sorted distinct patterns, their number, the
    hash of the original."""
    return masked.where(F.size("detections") > 0).select(
        F.lit(entity_type).alias("entity_type"),
        F.col(entity_id).alias("entity_id"),
        F.array_sort(F.array_distinct(F.col("detections.pattern"))).alias("patterns"),
        F.size("detections").alias("n_masked"),
        F.sha2(original, 256).alias("original_hash"),
    )


def pii_counts(df: DataFrame, column: str, patterns: dict[str, tuple[str, str]] = SERVER) -> DataFrame:
    """Matches of each pattern over a whole column, one pass, natively (P7); classes and boundaries are
    those of all letters and digits, as in Python."""
    sums = [F.coalesce(F.sum(F.regexp_count(column, F.lit("(?U)" + p))), F.lit(0)).alias(name) for name, (p, _) in patterns.items()]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).cast("long").alias("matches")) for n in patterns))).alias("x")).select("x.*")
