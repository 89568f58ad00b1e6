"""Token counts of the sections of documents, from one encoding of each whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import blocks, encoder

COUNTS = "doc_id long, section int, begin_char long, end_char long, n_tokens long, n_shared long"


def sections_of(text: str, separator: str) -> np.ndarray:
    """Where each section begins; a separator ends the section before it.  A text has one at least."""
    starts, at = [0], text.find(separator)
    while at >= 0 and at + len(separator) < len(text):
        starts.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return np.array(starts, np.int64)


def allot(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """The section of each token span, and whether the token touches several.  Spans and sections
    are sorted, sections leave no gap.  A token goes to the section that holds most of its
    characters, the first such; one without characters goes where it begins."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.maximum(first, np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1)
    crossing = last > first
    section = first.copy()
    for k in np.flatnonzero(crossing):
        s = np.arange(first[k], last[k] + 1)
        held = np.minimum(end[k], stops[s]) - np.maximum(begin[k], starts[s])
        section[k] = s[np.argmax(held)]
    return section, crossing


def token_counts(docs: DataFrame, tokenizer: str, separator: str = "\n") -> DataFrame:
    """One row for each section of each document (doc_id, text; other columns are ignored):
    doc_id, section (0, 1, ...), begin_char, end_char, n_tokens allotted to it by `allot`, and
    n_shared of those that reach over an edge of a section.  The sum over a document is the number
    of ids of its whole text.  A null or empty text is one empty section without tokens."""

    def run(batches):
        use = encoder(tokenizer, offsets=True)
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                part = texts[a:b]
                _, counts, begin, end = use.encode(part)
                size = np.fromiter(map(len, part), np.int64, len(part))
                # one gap between documents, so that empty texts have a place of their own
                base = np.cumsum(size + 1) - size - 1
                found = [sections_of(t, separator) for t in part]
                n = np.fromiter(map(len, found), np.int64, len(found))
                doc = np.repeat(np.arange(len(part)), n)
                starts = np.concatenate(found) + base[doc]
                stops = np.append(starts[1:], 0)
                last = np.cumsum(n) - 1
                stops[last] = base + size
                lead = np.repeat(base, counts)
                section, crossing = allot(begin + lead, end + lead, starts, stops)
                tokens = np.bincount(section, minlength=len(starts))
                shared = np.bincount(section[crossing], minlength=len(starts))
                order = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(doc)), pa.array(order.astype(np.int32)), pa.array(starts - base[doc]), pa.array(stops - base[doc]), pa.array(tokens.astype(np.int64)), pa.array(shared.astype(np.int64))],
                    [x.split()[0] for x in COUNTS.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)
