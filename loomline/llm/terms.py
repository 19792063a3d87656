"""How often every term, or n-gram of terms, occurs, and in how many records.

Suffix-sorted counting: every position of a record gives the suffix that starts there, cut to ``max_n`` terms. Suffixes are
sorted reverse-lexicographically, so that all suffixes with a common prefix stand together, and one pass over the sorted
suffixes counts all prefixes: the length of the prefix shared with the suffix before says which prefixes end there, as a
stack would pop them. Every prefix keeps the set of records it was met in.

The suffixes of a record never leave the task that reads it: they are sorted and counted there, in column arrays, for a few
ten thousand records at a time, and only (n-gram, occurrences, records) leaves the task. Records of different tasks differ,
so these add up. Routing is by the whole n-gram after that counting rather than by the bare first term before it; a first
term that a third of all tokens share then costs one row per block and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that are sorted and counted together; a record is never divided.
BLOCK = 2_000_000


def _suffixes(code: np.ndarray, row: np.ndarray, max_n: int) -> np.ndarray:
    """Matrix of the suffix at each position, cut to ``max_n`` terms, -1 beyond the record's end."""
    out = np.full((len(code), max_n), -1, np.int32)
    out[:, 0] = code
    for k in range(1, min(max_n, len(code))):
        same = row[k:] == row[:-k]
        out[:-k, k][same] = code[k:][same]
    return out


def _counted(suffix: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the n-grams (matrix), occurrences and records."""
    by = np.lexsort([row, *(-suffix[:, k] for k in reversed(range(suffix.shape[1])))])
    suffix, row = suffix[by], row[by]
    # Length of the prefix that each suffix shares with the one before it.
    shared = np.zeros(len(suffix), np.int32)
    alike = np.ones(max(len(suffix) - 1, 0), bool)
    for k in range(suffix.shape[1]):
        alike &= suffix[1:, k] == suffix[:-1, k]
        shared[1:] += alike
    for k in range(1, suffix.shape[1] + 1):
        long = suffix[:, k - 1] >= 0
        if not long.any():
            return
        group = np.cumsum(shared < k)[long] - 1  # a new prefix of k terms begins where fewer than k are shared
        pairs = np.unique(group.astype(np.int64) * (int(row.max()) + 1) + row[long])
        met, records = np.unique(pairs // (int(row.max()) + 1), return_counts=True)
        ids, first, times = np.unique(group, return_index=True, return_counts=True)
        assert len(met) == len(ids)
        yield suffix[long][first][:, :k], times, records


def _block(lists: list[pa.Array], max_n: int) -> Iterator[pa.RecordBatch]:
    joined = pa.concat_arrays(lists)
    row = pc.list_parent_indices(joined)
    term = pc.list_flatten(joined)
    keep = pc.not_equal(term, "")
    row, term = row.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64), term.filter(keep)
    if not len(term):
        return
    coded = term.dictionary_encode()
    names = coded.dictionary
    for gram, times, records in _counted(_suffixes(coded.indices.to_numpy(zero_copy_only=False), row, max_n), row):
        parts = [names.take(pa.array(gram[:, k])) for k in range(gram.shape[1])]
        text = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([text.cast(pa.string()), pa.array(times), pa.array(records)], names=["term", "n", "n_rows"])


def ngram_counts(df: DataFrame, text: str = "text", max_n: int = 1) -> DataFrame:
    """``(term, n, n_rows)``: occurrences of every n-gram of 1 to ``max_n`` terms and the number of rows that hold it.

    A term is a longest run of a-z and 0-9 in the lower-cased text; the terms of an n-gram stand next to each other in one row
    and are joined by a space. Rows count as they are delivered, repeated ones again. Null, empty and term-less texts give
    nothing, an empty table gives an empty result, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for b in batches:
            held.append(b.column(0))
            size += len(b.column(0).values)
            if size >= BLOCK:
                yield from _block(held, max_n)
                held, size = [], 0
        if held:
            yield from _block(held, max_n)

    terms = df.where(F.col(text).isNotNull()).select(F.split(F.lower(text), "[^a-z0-9]+").alias("terms"))
    return terms.mapInArrow(run, "term string, n long, n_rows long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def marked_terms(df: DataFrame, text: str = "text", max_n: int = 1, rare_rows: int = 2, common_share: float = 0.15) -> DataFrame:
    """:func:`ngram_counts` with ``mark``: ``rare`` in at most ``rare_rows`` rows, else ``common`` in more than
    ``common_share`` of the rows whose text is not null, else null."""
    rows = df.agg(F.count(text).alias("n_all")).scalar()
    # compared as whole numbers: 15 of 100 rows exactly is not common
    common = F.col("n_rows") * 10_000 > F.lit(round(common_share * 10_000)) * rows
    mark = F.when(F.col("n_rows") <= rare_rows, "rare").when(common, "common")
    return ngram_counts(df, text, max_n).withColumn("mark", mark)
