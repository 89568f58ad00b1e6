"""Rows and queries of one key met in blocks of bounded size (V1-V6, V7, V8).

Every row of a key is scored against every query of it.  Both sides are dealt into parts, and each
task group holds one part of rows and one of queries, so no task grows with a key; what a block
returns is exact for its rows, and the caller merges the blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The usual size of a block.  Rows are sent to each part of a key's queries; those are scored in chunks,
# so that a part of many takes no more memory than its vectors.
ROWS, QUERIES = 16_384, 8_192
CHUNK = 256  # queries of a block that are scored at once
GROUPS = 256  # of the scores of a query whose greatest bound its nearest
NEAR = 1e-5  # more than the error of a float32 cosine
BLANK = re.compile(r"[ \t\n\x0b\f\r]+")  # \s of Spark's regular expressions


def dealt(rows: DataFrame, queries: DataFrame, keys: list[str], row_id: list[str], query_id: list[str], n_rows: int = ROWS, n_queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of rows (_r) and of queries (_q) in which they meet: a row goes to each
    part of its key's queries, a query to each part of its key's rows, so each pair meets once."""

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        # only keys of several parts, which are fewer than rows / size
        return F.broadcast(df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name)).where(F.col(name) > 1))

    of_rows, of_queries = parts(rows, n_rows, "_rows"), parts(queries, n_queries, "_queries")

    def placed(df: DataFrame, ident: list[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        found = df.join(of_rows, keys, "left").join(of_queries, keys, "left")
        return found.withColumns({own[1]: F.pmod(F.xxhash64(*ident), n(own[0])).cast("int"), other[1]: F.explode(F.sequence(F.lit(0), n(other[0]) - 1))}).drop("_rows", "_queries")

    one, two = ("_rows", "_r"), ("_queries", "_q")
    return placed(rows, row_id, one, two), placed(queries, query_id, two, one)


def blocked(rows: DataFrame, queries: DataFrame, key: str, row_id: str, query_id: str, fn: Callable, schema: StructType, n_rows: int = ROWS, n_queries: int = QUERIES) -> DataFrame:
    """fn(rows, queries) of Arrow tables for each pair of a part of rows and a part of queries of a key."""
    left, right = dealt(rows, queries, [key], [row_id], [query_id], n_rows, n_queries)
    empty = {f.name: [] for f in schema}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = fn(left, right) if len(left) and len(right) else None
        return pa.table({n: pa.array([], t) for n, t in zip(empty, kinds)}) if made is None else made

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]
    by = [key, "_r", "_q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


class Vectors:
    """Vectors of a column as one matrix: sizes (-1: null, or holding nulls) and norms beside it."""

    def __init__(self, column: pa.ChunkedArray):
        held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(held, pa.ChunkedArray):
            held = pa.concat_arrays(held.chunks)
        begin = held.offsets.to_numpy()[:-1].astype(np.int64)
        self.size = np.where(held.is_valid().to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy()), -1).astype(np.int64)
        values = np.append(held.values.to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
        if held.values.null_count:
            nulls = np.append(0, np.cumsum(held.values.is_null().to_numpy(zero_copy_only=False)))
            self.size[nulls[begin + np.maximum(self.size, 0)] > nulls[begin]] = -1
        place = np.arange(max(0, int(self.size.max(initial=0))))
        inside = place[None, :] < self.size[:, None]
        self.rows = values[np.where(inside, begin[:, None] + place[None, :], len(values) - 1)]
        self.columns = np.ascontiguousarray(self.rows.T)
        with np.errstate(all="ignore"):
            total = np.zeros(len(self.size))
            for x in self.columns:  # in this order, as the same sum in Spark's expression
                total += x * x
            self.norm = np.sqrt(total)
            self.unit = (self.rows / np.where(self.norm > 0, self.norm, 1.0)[:, None]).astype(np.float32)
        self.null = self.size < 0
        self.zero = ~self.null & (self.norm == 0)
        self.odd = ~self.null & ~self.zero & ~((self.norm > 1e-100) & (self.norm < 1e100))

    def near(self, other: "Vectors", a: int, b: int, odd: float) -> np.ndarray:
        """Cosines of vectors a to b with all of other's, within NEAR; -inf where there is none, odd where
        only double precision tells."""
        width = min(self.rows.shape[1], other.rows.shape[1])
        with np.errstate(all="ignore"):
            s = self.unit[a:b, :width] @ other.unit[:, :width].T
        if len(set(self.size[a:b].tolist()) | set(other.size.tolist())) > 1:
            s[self.size[a:b, None] != other.size[None, :]] = -np.inf
        s[self.zero[a:b]] = 0
        s[:, other.zero] = 0
        s[self.odd[a:b]] = odd
        s[:, other.odd] = odd
        s[self.null[a:b]] = -np.inf
        s[:, other.null] = -np.inf
        return s

    def cosine(self, other: "Vectors", i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, is null) of pairs, as scoring.cosine gives them."""
        with np.errstate(all="ignore"):
            dot = np.zeros(len(i))
            for x, y in zip(self.columns, other.columns):
                dot += x[i] * y[j]
            size = self.norm[i] * other.norm[j]
            score = np.where(size == 0, 0.0, dot / size)
        return score, self.null[i] | other.null[j] | ((size != 0) & (self.size[i] != other.size[j]))


def first(query: np.ndarray, score: np.ndarray, null: np.ndarray, ident: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The places of each query's first `limit` by descending score (NaN first, nulls last), then id."""
    nan = np.isnan(score) & ~null
    names = np.unique(ident, return_inverse=True)[1]
    order = np.lexsort((names, np.where(null | nan, 0.0, -score), ~nan, null, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < limit[q]]


def floor(scores: np.ndarray, n: int) -> np.ndarray:
    """Of each row of scores a bound that at least n of them reach, close to the n-th greatest: the n-th
    greatest of the maxima of groups, which costs less than parting all."""
    width = scores.shape[1]
    if 2 * n > GROUPS or width < 2 * GROUPS:
        return np.partition(scores, width - n, axis=1)[:, width - n]
    best = scores[:, :GROUPS].copy()
    for k in range(GROUPS, width, GROUPS):
        part = scores[:, k : k + GROUPS]
        np.maximum(best[:, : part.shape[1]], part, out=best[:, : part.shape[1]])
    return np.partition(best, GROUPS - n, axis=1)[:, GROUPS - n]


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def nearest(rows: DataFrame, queries: DataFrame, key: str, ident: str, n_rows: int = ROWS, n_queries: int = QUERIES) -> DataFrame:
    """Of each query (key, query_id, _vector, _limit) its _limit nearest rows (key, ident, _vector, ...)
    of each block, ordered by cosine, then ident: query_id, score, and the rows' other columns.  The
    nearest of all are the first of these.  Cosines of float32 choose the candidates, with room for
    their error; those are scored in double."""
    names = [c for c in rows.columns if c not in (key, "_vector")]
    schema = StructType([queries.schema["query_id"], *StructType.fromDDL("score double"), *(rows.schema[c] for c in names)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r, q = Vectors(left["_vector"]), Vectors(right["_vector"])
        ids, limit = numbers(left[ident]), numbers(right["_limit"])
        found = []
        for a in range(0, len(right), CHUNK):
            s = q.near(r, a, min(a + CHUNK, len(right)), -np.inf)
            n = min(int(limit[a : a + CHUNK].max()), s.shape[1])
            if n <= 0:
                continue
            i, j = np.divmod(np.flatnonzero((s >= (floor(s, n) - np.float32(NEAR))[:, None]) | r.odd), s.shape[1])
            i += a
            score, null = q.cosine(r, i, j)
            keep = first(i, score, null, ids[j], limit)
            found.append((i[keep], j[keep], score[keep], null[keep]))
        if not found:
            return None
        i, j, score, null = (np.concatenate(x) for x in zip(*found))
        taken = left.select(names).take(pa.array(j))
        return pa.table([right["query_id"].take(pa.array(i)), pa.array(score, pa.float64(), mask=null), *taken.columns], names=["query_id", "score", *names])

    return blocked(rows, queries, key, ident, "query_id", run, schema, n_rows, n_queries)


def similar(rows: DataFrame, key: str, ident: str, threshold: float, n_rows: int = ROWS) -> DataFrame:
    """All pairs of one key's rows (key, ident long, _vector) with a cosine of at least threshold, each
    row with itself too: key, a <= b, score."""
    schema = StructType([rows.schema[key], *StructType.fromDDL("a long, b long, score double")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r, q = Vectors(left["_vector"]), Vectors(right["_vector"])
        one, two = numbers(right[ident]), numbers(left[ident])
        found = []
        for a in range(0, len(right), CHUNK):
            s = q.near(r, a, min(a + CHUNK, len(right)), np.inf)
            i, j = np.nonzero(s >= np.float32(threshold - NEAR))
            i += a
            up = one[i] <= two[j]
            i, j = i[up], j[up]
            score, null = q.cosine(r, i, j)
            good = ~null & (np.isnan(score) | (score >= threshold))
            found.append((one[i[good]], two[j[good]], score[good]))
        x, y, score = (np.concatenate(v) for v in zip(*found))
        owner = left[key].take(pa.array(np.zeros(len(x), np.int64)))
        return pa.table([owner, pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(score, pa.float64())], names=[key, "a", "b", "score"])

    return blocked(rows, rows.toDF(*rows.columns), key, ident, ident, run, schema, n_rows, n_rows)


def worded(rows: DataFrame, queries: DataFrame, key: str, ident: str, k: int, n_rows: int = 2_048, n_queries: int = 512) -> DataFrame:
    """Of each query (key, query_id, _words) the k rows (key, ident, _text) of each block that hold most
    of its words as parts of their text: query_id, ident, score (the share of the words, above 0)."""
    schema = StructType([queries.schema["query_id"], rows.schema[ident], *StructType.fromDDL("score double")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right["_words"].to_pylist()
        words = {w: n for n, w in enumerate(dict.fromkeys(w for one in asked for w in one))}
        wanted = np.zeros((len(asked), len(words)), np.float32)
        for i, one in enumerate(asked):
            for w in one:
                wanted[i, words[w]] += 1
        # a word has no blank in it, so it is part of a text if it is part of one of the text's tokens;
        # each distinct token of the block is searched once
        tokens: dict[str, int] = {}
        texts = [{tokens.setdefault(x, len(tokens)) for x in BLANK.split(text.as_py())} for text in left["_text"]]
        every, ends = "\n".join(tokens), np.cumsum([len(x) + 1 for x in tokens])
        of: dict[int, list[int]] = {}
        for w, n in words.items():
            at, places = every.find(w), []
            while at >= 0:
                places.append(at)
                at = every.find(w, at + 1)
            for token in set(np.searchsorted(ends, places, side="right").tolist()):
                of.setdefault(token, []).append(n)
        held = np.zeros((len(left), len(words)), np.float32)
        for j, text in enumerate(texts):
            held[j, list(set().union(*(of[token] for token in text & of.keys())))] = 1
        ids, size = numbers(left[ident]), wanted.sum(axis=1, dtype=np.float64)
        found = []
        for a in range(0, len(asked), CHUNK):
            s = wanted[a : a + CHUNK] @ held.T
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            i, j = np.nonzero((s >= least[:, None]) & (s > 0))
            score = s[i, j].astype(np.float64) / np.maximum(size[i + a], 1)
            keep = first(i, score, np.zeros(len(i), bool), ids[j], np.full(len(asked), k))
            found.append((i[keep] + a, j[keep], score[keep]))
        i, j, score = (np.concatenate(v) for v in zip(*found))
        return pa.table([right["query_id"].take(pa.array(i)), left[ident].take(pa.array(j)), pa.array(score, pa.float64())], names=["query_id", ident, "score"])

    return blocked(rows, queries, key, ident, "query_id", run, schema, n_rows, n_queries)
