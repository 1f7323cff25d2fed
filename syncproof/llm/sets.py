"""Sets of 64-bit hashes laid end to end, and their Jaccard similarities, in vectorised numpy.

Sets and pairs of a slice are numbered in the 12 high bits of a sorting key, so the values compared are the other 52 bits of
the hashes: two unlike elements of a pair of thousand-element sets are taken for one in about one of 10^9 pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncproof.llm.common import slices

NUMBER = 12
MOST = 1 << NUMBER
VALUE = np.uint64((1 << (64 - NUMBER)) - 1)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def spread(h: np.ndarray) -> np.ndarray:
    """uint64 values, their bits well spread, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def char_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-character shingles of each text, end to end, repeats included; their counts). A shorter text is padded to one."""
    strings = [t if len(t) >= k else t.ljust(k, "\0") for t in texts.to_pylist()]
    counts = np.fromiter(map(len, strings), np.int64, len(strings)) - (k - 1)
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(codes) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + n]
    return spread(h[runs(np.cumsum(counts + k - 1) - (counts + k - 1), counts)]), counts


def distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of each set once, sorted, end to end; the sets' sizes) of at most MOST sets."""
    keys = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(64 - NUMBER), counts)
    keys |= h >> np.uint64(NUMBER)
    keys.sort()
    keys = keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
    return keys & VALUE, np.bincount((keys >> np.uint64(64 - NUMBER)).astype(np.int64), minlength=len(counts))


def shared(values: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many values the sets p[i] and q[i] have in common; at most MOST pairs."""
    starts = np.cumsum(sizes) - sizes
    number = np.arange(len(p), dtype=np.uint64) << np.uint64(64 - NUMBER)
    keys = np.concatenate([np.repeat(number, sizes[x]) | values[runs(starts[x], sizes[x])] for x in (p, q)])
    keys.sort()
    return np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - NUMBER)).astype(np.int64), minlength=len(p))


def similar_pairs(both: DataFrame, shingles: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], similar: float) -> DataFrame:
    """both (a, b, x: text of a, y: text of b) -> the (a, b) whose texts' sets have that Jaccard similarity or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "x", rows=MOST // 2, nbytes=1 << 20):
                for part in slices(half, "y", rows=MOST // 2, nbytes=1 << 20):
                    a, b = (part.column(i).to_numpy() for i in range(2))
                    ids, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
                    texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
                    values, sizes = distinct(*shingles(texts))
                    p, q = at[: len(a)], at[len(a) :]
                    may = np.flatnonzero(np.minimum(sizes[p], sizes[q]) >= similar * np.maximum(sizes[p], sizes[q]))
                    common = shared(values, sizes, p[may], q[may])
                    keep = may[common >= similar * (sizes[p[may]] + sizes[q[may]] - common)]
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def common_values(values: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, width: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(how many values the sets x[i] and y[j] have in common, all sets' sizes), by products of 0/1 matrices of so many values at a time."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, number, held = np.unique(values, return_inverse=True, return_counts=True)
    several = held > 1
    column = (np.cumsum(several) - 1)[number]
    keep = several[number]
    owner, column = owner[keep], column[keep]
    common = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    bounds = np.searchsorted(column, np.arange(0, int(several.sum()) + width, width))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        held_by = np.zeros((len(sizes), width), np.float32)
        held_by[owner[a:b], column[a:b] - k * width] = 1
        common += held_by[x] @ held_by[y].T
    return common, sizes


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with the contents x and y of texts (id, content)."""
    return pairs.join(texts.select(F.col("id").alias("a"), F.col("content").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("content").alias("y")), "b")
