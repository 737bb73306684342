"""Problem 6: splitting oversized items at natural boundaries.

A sparse table over boundary strengths answers "which is the strongest cut in this
window, the rightmost of equals" in constant time; pieces are laid by asking it for
the end of each piece and for the start of the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.storage import ship


class RangeMaximum:
    """Positions of maxima over windows of at most ``widest`` places; of equal ones the rightmost."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.strength = strength
        n = len(strength)
        self.levels = [np.arange(n, dtype=np.int32)]
        width = 1
        while 2 * width <= min(n, widest):
            last = self.levels[-1]
            left, right = last[: n - 2 * width + 1], last[width : n - width + 1]
            self.levels.append(np.where(strength[right] >= strength[left], right, left))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int | None:
        """The place in [lo, hi] with the strongest boundary, None without any (strength 0) or with an empty window."""
        lo, hi = max(lo, 0), min(hi, len(self.strength) - 1)
        if lo > hi:
            return None
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        best = b if self.strength[b] >= self.strength[a] else a
        return best if self.strength[best] > 0 else None


@dataclass(frozen=True)
class Limits:
    """Pieces of at most ``size`` ids that share ``overlap`` to ``most_overlap`` ids with the one before."""

    size: int = 1024
    overlap: int = 64
    most_overlap: int = 256

    def __post_init__(self):
        if not 0 <= self.overlap <= self.most_overlap < self.size:
            raise ValueError("need 0 <= overlap <= most_overlap < size")


def pieces(strength: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """[start, end) of each piece; a boundary at place p is a cut just before p."""
    n = len(strength)
    if n <= limits.size:
        return [(0, n)]
    best = RangeMaximum(strength, limits.size)
    out, start, beyond = [], 0, limits.overlap
    while n - start > limits.size:
        end = best.argmax(beyond + 1, start + limits.size)
        end = start + limits.size if end is None else end
        out.append((start, end))
        back = best.argmax(max(start + 1, end - limits.most_overlap), end - limits.overlap)
        start, beyond = (end - limits.overlap if back is None else back), end
    return [*out, (start, n)]


def split_sequences(sequences: DataFrame, limits: Limits = Limits(), strengths: dict[int, int] | None = None) -> DataFrame:
    """``(seq_id, piece, start_pos, end_pos)`` of each sequence longer than ``limits.size``.

    ``sequences`` has ``seq_id`` and ``tokens`` (array<int>); ``strengths`` gives the
    strength of the cut before each boundary id (default: a measure, 3, has 1). NULL
    ids inside a sequence are no boundaries. NULL, empty and short sequences have no
    pieces here; a row that occurs twice is split twice; a NULL ``seq_id`` stays NULL.
    A sequence is cut whole in one task, in memory proportional to its own length.
    """
    ship(sequences.sparkSession)
    strong = dict({3: 1} if strengths is None else strengths)
    schema = pa.schema([("seq_id", pa.int64()), ("piece", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq_id, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.values.fill_null(-1).to_numpy(zero_copy_only=False)
                strength = np.zeros(len(ids), dtype=np.int32)
                for token, s in strong.items():
                    strength[ids == token] = s
                rows += [(seq_id, i, a, b) for i, (a, b) in enumerate(pieces(strength, limits))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    longer = sequences.where(F.size("tokens") > limits.size).select(F.col("seq_id").cast("bigint").alias("seq_id"), "tokens")
    return longer.mapInArrow(run, "seq_id bigint, piece int, start_pos int, end_pos int")
