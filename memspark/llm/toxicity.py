"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained on ordinary texts, toxic ones on the windows of toxic texts that
are some, many or very many times as frequent in toxic texts as in ordinary ones.  A window's
distance is by how many bytes a toxic dictionary compresses it shorter than the ordinary one does;
a document is judged by how many of its windows reach each of several distances, for all of which
weights and one threshold are calibrated on labelled documents outside of the dictionaries.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

LONGEST = 48  # characters of a window; longer words are cut into windows that overlap by half
REPEAT = 4  # a window is written so often in a frame, else it is too short to be compressed at all
LEVELS = (2, 3, 4, 5, 6, 7)  # bytes of gain that are counted
ODDS = (4.0, 20.0, 60.0)  # how many times as frequent in toxic texts: the least of each toxic dictionary
FLOOR = 3  # toxic texts that a window must be in


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: list[bytes]
    coefficients: list[float]
    key: int


def windows(text: str) -> list[str]:
    words = text.lower().split()
    if max(map(len, words), default=0) > LONGEST:
        step = LONGEST // 2
        words = [w[k : k + LONGEST] for w in words for k in (range(0, len(w) - step, step) if len(w) > LONGEST else (0,))]
    return words


def frame(window: str) -> bytes:
    return ((" " + window) * REPEAT + " ").encode("utf-8", "surrogatepass")


def compressor(dictionary: bytes):
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0, compression_level=19, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, window_log=17)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), compression_params=params).compress


def dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """A trained dictionary, or the samples' last bytes themselves where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"        "


class Gains(dict):
    """Window -> its number; gain has, for each number and toxic dictionary, the bytes that the
    dictionary saves against the ordinary one.  Each distinct window is compressed once."""

    def __init__(self, ordinary: bytes, toxic: list[bytes], most: int = 1_000_000):
        super().__init__()
        self.ordinary, self.toxic, self.most = compressor(ordinary), [compressor(t) for t in toxic], most
        self.gain = array("i")

    def __missing__(self, window: str) -> int:
        data = frame(window)
        plain = len(self.ordinary(data))
        self.gain.extend([plain - len(c(data)) for c in self.toxic])
        self[window] = number = len(self)
        return number

    def features(self, text: str) -> np.ndarray:
        """One, for each dictionary and level how many windows gain so much (as a logarithm, and for each
        20 windows), and the logarithm of the number of windows."""
        if len(self) >= self.most:  # between texts, so that a text's numbers stay
            self.clear()
            self.gain = array("i")
        words = windows(text)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        gain = np.frombuffer(self.gain, np.intc).reshape(-1, len(self.toxic))[numbers] if words else np.zeros((0, len(self.toxic)), np.intc)
        gain = gain[gain.max(axis=1, initial=0) >= LEVELS[0]]  # few windows gain anything
        count = (gain[:, :, None] >= np.array(LEVELS)).sum(0).ravel()
        return np.concatenate([[1.0], np.log1p(count), count * (20 / max(20, len(words))), [math.log1p(len(words))]])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, steps: int = 100) -> np.ndarray:
    """Coefficients of a logistic regression with a ridge penalty (none for the first) on standardised
    columns, by Newton's method with steps that are halved until they help."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0, np.where(scale > 1e-9, scale, 1)
    scale[0] = 1
    z = (x - mean) / scale
    penalty = np.full(z.shape[1], ridge * weight.sum() / len(y))
    penalty[0] = 1e-9

    def loss(b):
        t = z @ b
        return weight @ (np.logaddexp(0, t) - y * t) + penalty @ (b * b) / 2

    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - penalty * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        move, size, now = np.linalg.solve(h, g), 1.0, loss(b)
        while size > 1e-6 and loss(b + size * move) > now:
            size /= 2
        b = b + size * move
        if np.abs(size * move).max() < 1e-7:
            break
    b = b / scale
    b[0] -= mean @ b
    return b


def fit(toxic: list[str], ordinary: list[str], toxic_all: int, ordinary_all: int, ordinary_texts: int = 2600, ordinary_size: int = 1 << 17, toxic_size: int = 1 << 13, toxic_weight: float = 2.0) -> ToxicityModel:
    """Dictionaries and calibration from labelled texts.

    Two thirds of each class train the dictionaries: the ordinary one up to ordinary_texts whole
    texts, each toxic one those windows of all toxic texts whose odds are in its range, one sample a
    text, so that a window weighs by the texts that it is in.  A logistic regression on the features
    of the other third, each class weighted as in all labelled rows and toxic texts toxic_weight times
    more, makes the score; so what a window must gain, and how many must, is learnt and not set."""
    none = b"        "
    if not toxic or not ordinary:
        p = min(max(toxic_all / max(1, toxic_all + ordinary_all), 0.001), 0.999)
        return ToxicityModel(none, [none] * len(ODDS), [math.log(p / (1 - p))] + [0.0] * (2 * len(ODDS) * len(LEVELS) + 1), hash(p))
    cut = lambda texts: (texts[: max(1, 2 * len(texts) // 3)], texts[2 * len(texts) // 3 :] or texts)
    (t_fit, t_test), (o_fit, o_test) = cut(toxic), cut(ordinary)
    in_toxic = [sorted(set(windows(t))) for t in t_fit]
    seen = Counter(w for ws in in_toxic for w in ws)
    usual = Counter(w for t in o_fit for w in set(windows(t)) & seen.keys())
    odds = {w: n / len(t_fit) * len(o_fit) / (usual[w] + 0.5) for w, n in seen.items() if n >= min(FLOOR, len(t_fit))}
    base = dictionary([(" " + " ".join(windows(t)) + " ").encode("utf-8", "surrogatepass") for t in o_fit[:ordinary_texts]], ordinary_size, 64)
    made: list[bytes] = []
    for low, high in zip(ODDS, [*ODDS[1:], math.inf]):
        lists = ([w for w in ws if low <= odds.get(w, 0) < high] for ws in in_toxic)
        samples = [(" " + "  ".join(ws) + " ").encode("utf-8", "surrogatepass") for ws in lists if ws]
        made.append(dictionary(samples, toxic_size, 32) if samples else none)
    gains = Gains(base, made)
    x = np.array([gains.features(t) for t in t_test + o_test])
    y = np.array([1.0] * len(t_test) + [0.0] * len(o_test))
    weight = np.where(y == 1, toxic_weight * toxic_all / len(t_test), ordinary_all / len(o_test))
    b = fit_logistic(x, y, weight * len(y) / weight.sum())
    return ToxicityModel(base, made, b.tolist(), hash((base, *made)))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_ordinary: int = 8000) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0/1; null ids and labels are left
    out, a document with several labels counts as toxic if one says so).  The class sizes come from
    all labels; the texts are a bounded sample, at most most_toxic and most_ordinary documents,
    those whose doc_id has the smallest hash, and are fitted in one task."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).na.drop()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = known.where("toxic = 1").orderBy(order).limit(most_toxic).unionByName(known.where("toxic <> 1").orderBy(order).limit(most_ordinary))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample has most_toxic + most_ordinary rows at most
    sample = texts.join(F.broadcast(chosen), "doc_id")
    toxic_all = sizes.get(1, 0)
    ordinary_all = sum(sizes.values()) - toxic_all

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=pdf["doc_id"] * 2654435761 % 4294967291).sort_values(["h", "doc_id", "text"])
        m = fit(pdf["text"][pdf["toxic"] == 1].tolist(), pdf["text"][pdf["toxic"] != 1].tolist(), toxic_all, ordinary_all)
        return pd.DataFrame({"ordinary": [m.ordinary], "toxic": [m.toxic], "coefficients": [m.coefficients]})

    made = sample.groupBy().applyInPandas(run, "ordinary binary, toxic array<binary>, coefficients array<double>").first()
    if made is None:
        return fit([], [], toxic_all, ordinary_all)
    parts = bytes(made["ordinary"]), [bytes(t) for t in made["toxic"]]
    return ToxicityModel(*parts, list(made["coefficients"]), hash((parts[0], *parts[1])))


_GAINS: dict[int, Gains] = {}


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold, else 0) of every row of docs
    (doc_id, text; other columns are ignored).  Null text counts as empty and has a score, too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        if m.key not in _GAINS:
            _GAINS.clear()
            _GAINS[m.key] = Gains(m.ordinary, m.toxic)
        gains, b = _GAINS[m.key], np.array(m.coefficients)
        for batch in batches:
            x = np.array([gains.features(t or "") for t in texts_of(batch.column(1))]).reshape(-1, len(b))
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
