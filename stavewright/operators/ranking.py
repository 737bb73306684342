"""Ranks and running sums that no single task computes alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavewright.storage import materialize, ship


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add column ``name``: the sum of ``value`` over the rows before this one, within ``keys`` by ``order``.

    One shuffle: rows are range-partitioned by (keys, order), sorted, summed up within
    their range in the same stage, and written. A key that holds a third of all rows
    spans many tasks; what such a key has before a range is a row a range at most, and
    is broadcast. NULL values count as 0, NULL keys are a key of their own, NULLs order
    first; rows equal in ``order`` come in some order, but each gets its own sum (and lie
    in one range, so ``order`` should be nearly unique). An empty table stays empty.
    """
    ship(df.sparkSession)
    # Adjacent keys are told apart by a hash that knows NULL from nothing.
    mark = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))]) if keys else F.lit(0).cast("bigint")
    sorted_ = (
        df.withColumn("_value", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))).withColumn("_mark", mark)
        .repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .sortWithinPartitions(*keys, *order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v, m = batch.column("_value").to_numpy(), batch.column("_mark").to_numpy()
            before = np.cumsum(v) - v
            first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            start = np.repeat(before[first], np.diff(np.append(first, len(m))))
            inside = before - start
            if m[0] == last:
                inside[: first[1] if len(first) > 1 else None] += total
            last, total = m[-1], int(inside[-1] + v[-1])
            extra = {"_inside": inside, "_range": np.full(len(v), part, dtype=np.int32)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra.values())], [*batch.schema.names, *extra])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in sorted_.schema], T.StructField("_inside", T.LongType()), T.StructField("_range", T.IntegerType())])
    ranged = materialize(sorted_.mapInArrow(run, schema), "ranged")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        F.sum("_total").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
    ).where("_before is not null")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # Of the keys of a range only the first can have begun in another: as many rows as ranges.
    return ranged.join(F.broadcast(before), same, "left").withColumn(name, F.coalesce("_before", F.lit(0).cast("bigint")) + F.col("_inside")).select(*df.columns, name)
