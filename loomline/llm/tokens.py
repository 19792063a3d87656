"""Exact ids of a byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a piece of text the encoding has one last token. At each position an automaton over the vocabulary
names the tokens that end there. Such a token is the last of its prefix iff it may follow the last token of the prefix
before it, which is so iff the vocabulary's merges leave just these two when they encode their joined bytes. That test
is kept per pair of tokens. Following the stored tokens back from the end gives the ids, without merging the text itself.

Each Python worker builds the automaton once, from a file whose place on the driver's machine is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps; the store is emptied when it is full, which changes no result.
KEPT = 200_000
#: Tests of pairs of tokens that a worker keeps, likewise.
PAIRS_KEPT = 2_000_000


class PrefixEncoder:
    def __init__(self, path: str = VOCABULARY) -> None:
        lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.word = {i: w for w, i in self.rank.items()}
        self.cut = regex.compile(PIECES).findall
        self.automaton = ahocorasick.Automaton()
        for w, i in self.rank.items():
            self.automaton.add_word(w.decode("latin-1"), (i, len(w)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by the vocabulary's merges as they are defined: the lowest pair first. Used on pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[x] for x in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.word[a] + self.word[b]) == [a, b]
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        if (whole := self.rank.get(data)) is not None:
            return (whole,)
        last = [-1] * len(data)  # the last token of the prefix that ends here
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            start = end - size
            if last[end] < 0 and (start < 0 or (last[start] >= 0 and self.follows(last[start], token))):
                last[end] = token
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.word[last[at]])
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for p in self.cut(text):
            if (ids := known.get(p)) is None:
                if len(known) >= KEPT:
                    known.clear()
                ids = self.piece(p)
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out


@cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _shipped(df: DataFrame, path: str) -> str:
    """Has the vocabulary sent to the workers, which need not have it; its name among the files sent."""
    df.sparkSession.sparkContext.addFile(path)  # once per application and path
    return Path(path).name


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: the token ids of every row's whole text, without special tokens.

    A null and an empty text have an empty list; white space has ids like any text. Strings of special tokens are ordinary
    text. Rows stay one to one, repeated ones too; an empty table gives an empty result; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    name = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            ids = [np.array(e.encode(t) if t else [], np.int32) for t in b.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_counts(df: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row; a null text has none."""
    kinds = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    name = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            n = pa.array([len(e.encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    renamed = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    out = renamed.mapInArrow(run, f"{kinds}, n_tokens long")
    return out.toDF(*keys, "n_tokens")
