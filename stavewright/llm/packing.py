"""Problem 7: filling fixed-capacity containers with items.

Minimum bin slack over the histogram of lengths. Lengths are at most the capacity, so
however many items there are, the histogram has at most ``capacity`` rows; the driver
plans on it. A plan step fills one container as full as it can be: the longest
remaining length, then a subset-sum over the rest, kept as a bitset of reachable sums
and backtracked to counts. The same filling is repeated for as many containers as the
histogram allows, so steps are bounded by the lengths, not by the items. Items get
their container by their rank among items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.operators.ranking import prefix_sums
from stavewright.storage import materialize, ship


@cache
def _classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, digit or underscore, 2 anything else."""
    table = np.full(0x110000, 2, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            table[i] = 1
        elif c.isspace():
            table[i] = 0
    return table


#: Texts are counted together up to so many characters, so memory doesn't follow the length of a batch (one text is one piece).
CHARS_AT_ONCE = 4 << 20


def _count(texts: list[str]) -> np.ndarray:
    joined = "\n".join(texts)  # white space between texts belongs to no token
    classes = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    starts = np.zeros(len(classes) + 1, dtype=np.int64)
    first = classes != 0
    first[1:] &= classes[1:] != classes[:-1]
    np.cumsum(first, out=starts[1:])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    return starts[ends] - starts[ends - lengths]


def count_tokens(texts: pa.Array) -> np.ndarray:
    """Tokens of each text: maximal runs of word characters, or of other characters but white space. NULL has none."""
    out, some, chars = [np.zeros(0, dtype=np.int64)], [], 0
    for text in texts:
        some.append(text.as_py() or "")
        chars += len(some[-1])
        if chars >= CHARS_AT_ONCE:
            out.append(_count(some))
            some, chars = [], 0
    if some:
        out.append(_count(some))
    return np.concatenate(out)


def token_counts(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` over whole texts; NULL and empty texts have 0."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_tokens(batch.column(1)))], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is at most ``room`` and closest to it, as counts.

    Bit s of ``reach`` says that sum s can be had. Counts are added in doubling
    bundles, so every number up to the count is possible; longer lengths come first,
    and the search ends as soon as ``room`` itself is reached.
    """
    reach, mask, bundles = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(bundle, left)
            bundles.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(bundles):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, from_rank, to_rank, first_container, each)``: ranks [from, to) of a length go ``each`` by ``each`` into containers from ``first_container``."""
    left = {x: n for x, n in histogram.items() if n > 0}
    ranked = dict.fromkeys(left, 0)
    container, out = 0, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fill({x: n for x, n in rest.items() if n}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            out.append((x, ranked[x], ranked[x] + times * n, container, n))
            ranked[x] += times * n
            left[x] -= times * n
            if not left[x]:
                del left[x]
        container += times
    return out


def pack(documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(doc_id, piece, start_token, end_token, doc_tokens, container)``: every document in its container.

    A document of at most ``capacity`` tokens is one piece, 0; a larger one is cut
    into full pieces and one remainder, and only such documents are cut. Documents
    without tokens (NULL, empty, white space) take no room: container NULL. Equal
    documents are items of their own; NULL ids are kept.

    The shuffle carries ids and lengths. Ranks within a length come from range
    partitions, so a length shared by a third of the items is no hot group; the plan
    is at most a few rows a length and its size doesn't depend on the items.
    """
    spark = documents.sparkSession
    sizes = materialize(token_counts(documents), "sizes")
    whole = F.expr(f"array(struct(0 AS piece, 0L AS start_token, n_tokens AS end_token))")
    cut = F.expr(f"transform(sequence(0L, div(n_tokens - 1, {capacity}L)), i -> struct(cast(i AS int) AS piece, i * {capacity}L AS start_token, least((i + 1) * {capacity}L, n_tokens) AS end_token))")
    pieces = sizes.withColumn("p", F.explode(F.when(F.col("n_tokens") <= capacity, whole).otherwise(cut))).select("doc_id", "p.*", F.col("n_tokens").alias("doc_tokens"), F.expr("p.end_token - p.start_token").alias("length"))
    full = pieces.where("length > 0")
    histogram = {r.length: r["count"] for r in full.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_containers(histogram, capacity) or [(0, 0, 0, 0, 1)], "len bigint, from_rank bigint, to_rank bigint, first bigint, each bigint")
    ranked = prefix_sums(full, ["length"], ["doc_id", "piece"], F.lit(1), "rank")
    placed = ranked.join(F.broadcast(plan), F.expr("length = len AND rank >= from_rank AND rank < to_rank")).withColumn("container", F.expr("first + div(rank - from_rank, each)"))
    columns = ["doc_id", "piece", "start_token", "end_token", "doc_tokens", "container"]
    return placed.select(*columns).unionByName(pieces.where("length = 0").withColumn("container", F.lit(None).cast("bigint")).select(*columns))
