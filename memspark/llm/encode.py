"""Exact, vectorised encoding with a public tokenizer file.

A text is cut at single spaces.  With the byte-level and word-level tokenizers used
here no pre-token reaches over a space that stands between two other characters, so
the ids of a text are the ids of its units one after another.  Units repeat far more
often than texts: each distinct unit goes once through the tokenizers library, and the
ids of a batch of texts are gathered with numpy.  The cache of units is bounded, and
lives as long as a Python worker.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

FIRST, END = "\ud800", "\udfff"  # lone surrogates mark a text's first unit and its end; no text has them
SPLIT = re.compile(r"(?<=\S) (?=\S)")


class _Units(dict):
    """Unit -> number; a unit that is met for the first time is queued for encoding."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = len(self)
        self[unit] = number
        self.queue.append(unit)
        return number


class _Flat:
    """A numpy array that grows."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(4096, kind), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(values), self.n), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class UnitEncoder:
    """ids of whole texts, equal to tokenizer.encode(text, add_special_tokens=False).

    tail: an id set after each text.  offsets: also give the character span of each id.
    Texts may be empty; None is not allowed.
    """

    def __init__(self, path: str, tail: int | None = None, offsets: bool = False, max_units: int = 1_200_000, max_chars: int = 30_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tail, self.offsets = tail, offsets
        self.max_units, self.max_chars = max_units, max_chars
        special = [t for t in json.loads(self.tokenizer.to_str())["added_tokens"] if t["special"] and not t["lstrip"] and not t["rstrip"]]
        self.mark = (special[0]["content"], special[0]["id"])
        assert tail is None or not offsets
        self._reset()

    def _reset(self) -> None:
        self.units = _Units()
        self.ids = _Flat(np.uint32)
        self.spans = [_Flat(np.int32), _Flat(np.int32)] if self.offsets else []
        self.start, self.length, self.chars, self.loose = _Flat(np.int64), _Flat(np.int32), _Flat(np.int32), _Flat(bool)
        self.seen = 0
        self.units[END] = 0
        tail = [] if self.tail is None else [self.tail]
        for flat, values in ((self.ids, tail), (self.start, [0]), (self.length, [len(tail)]), (self.chars, [0]), (self.loose, [False])):
            flat.extend(values)

    def _learn(self) -> None:
        queue, self.units.queue = self.units.queue, []
        for at in range(0, len(queue), 20_000):
            block = queue[at : at + 20_000]
            bare = [u[1:] if u[:1] == FIRST else " " + u for u in block]
            if self.offsets:
                encodings = self.tokenizer.encode_batch(bare, add_special_tokens=False)
                ids = [e.ids for e in encodings]
                for k, flat in enumerate(self.spans):
                    flat.extend([o[k] for e in encodings for o in e.offsets])
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                ids = [i for row in ids for i in row]
            else:
                ids, lengths = self._by_mark(bare)
            self.start.extend(self.ids.n + np.cumsum(lengths) - lengths)
            self.length.extend(lengths)
            self.ids.extend(ids)
            self.chars.extend(list(map(len, bare)))
            # a unit with white space at an edge isn't what stands between two single spaces
            self.loose.extend([u != FIRST and (u == "" or u[-1].isspace() or u[0].isspace() or u[:1] == FIRST and u[1].isspace()) for u in block])
            self.seen += sum(map(len, bare))

    def _by_mark(self, bare: list[str]):
        """(ids, lengths) of units, encoded in long lists with the tokenizer's own special token
        between them; units that hold its text go one by one."""
        text, mark = self.mark
        odd = [k for k, u in enumerate(bare) if text in u]
        clean = list(bare)
        for k in odd:
            clean[k] = ""
        marked = [text] * (2 * len(clean))
        marked[::2] = clean
        ids = np.array(self.tokenizer.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == mark)
        lengths = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != mark]
        assert len(lengths) == len(bare)
        if odd:
            rows = np.split(ids, np.cumsum(lengths)[:-1])
            for k in odd:
                rows[k] = np.array(self.tokenizer.encode(bare[k], add_special_tokens=False).ids, np.uint32)
            ids, lengths = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return ids, lengths

    def _numbers(self, split: list[list[str]], total: int):
        return np.fromiter(map(self.units.__getitem__, chain.from_iterable(split)), np.int64, total)

    def encode(self, texts: list[str]):
        """(ids, counts[, begin, end]): the ids of all texts, flat, and how many each text has."""
        if len(self.units) > self.max_units or self.seen > self.max_chars:
            self._reset()
        if not texts:
            none = np.zeros(0, np.uint32)
            return (none, np.zeros(0, np.int64)) + ((none, none) if self.offsets else ())
        split = [t.split(" ") for t in texts]
        for p in split:
            p[0] = FIRST + p[0]
            p.append(END)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = self._numbers(split, int(sizes.sum()))
        self._learn()
        at = np.cumsum(sizes) - sizes
        loose = np.flatnonzero(np.logical_or.reduceat(self.loose.data[numbers], at))
        if len(loose):
            for k in loose.tolist():
                split[k] = [*SPLIT.split(texts[k]), END]
                split[k][0] = FIRST + split[k][0]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            numbers = self._numbers(split, int(sizes.sum()))
            self._learn()
            at = np.cumsum(sizes) - sizes
        length = self.length.data[numbers].astype(np.int64)
        source = np.repeat(self.start.data[numbers] - (np.cumsum(length) - length), length)
        source += np.arange(len(source))
        counts = np.add.reduceat(length, at)
        if not self.offsets:
            return self.ids.data[source], counts
        chars = self.chars.data[numbers].astype(np.int64)
        unit_at = np.cumsum(chars) - chars
        unit_at -= np.repeat(unit_at[at], sizes)
        lead = np.repeat(unit_at, length)
        return self.ids.data[source], counts, self.spans[0].data[source] + lead, self.spans[1].data[source] + lead


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, tail: int | None = None, offsets: bool = False) -> UnitEncoder:
    """One encoder for each tokenizer file in a worker; its cache serves later tasks too."""
    key = (path, tail, offsets)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, tail, offsets)
    return _ENCODERS[key]


def blocks(texts: list, max_chars: int = 1_000_000):
    """(from, to) ranges of texts with about max_chars characters each."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def forget() -> None:
    """Drop the encoders of this worker: for jobs whose other stages run in the same workers."""
    _ENCODERS.clear()
