"""Corpus statistics, and the measures a language model is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.operators.ranking import prefix_sums


def nearest_rank(count: Column, p: float) -> Column:
    """0-based place of the ``p`` percentile among ``count`` sorted values: round half up, at most the last."""
    return F.least(F.round(F.lit(p) * count.cast("double")).cast("bigint"), count - 1)


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """A row a key with the percentile ``ps[name]`` of ``value`` as column ``name``; NULL values don't count.

    Values are counted first, so what is ranked is distinct values with running counts,
    over range partitions: no list is ever gathered. The value at place r is the one
    whose running count first exceeds r. Keys without values are absent.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = prefix_sums(counts, keys, [value], F.col("_n"), "_before")
    totals = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total")) if keys else ranked.agg(F.sum("_n").alias("_total"))
    both = ranked
    for i, k in enumerate(keys):
        totals = totals.withColumnRenamed(k, f"_k{i}")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = ranked.join(totals if keys else F.broadcast(totals), on)  # without keys the total is one row
    picks = []
    for name, p in ps.items():
        at = nearest_rank(F.col("_total"), p)
        picks.append(F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col(value))).alias(name))
    return both.groupBy(*keys).agg(*picks) if keys else both.agg(*picks)


def corpus_stats(entries: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """A row a key: ``files_ok, files_failed, total_tokens, min_tokens, p50, p90, max_tokens``.

    ``entries`` has ``tokens``, ``errors`` a row a failed file. A key with failures
    only has total 0 and NULL percentiles, like an empty corpus.
    """
    ok = entries.groupBy(*keys).agg(F.count("tokens").alias("files_ok"), F.sum("tokens").alias("total_tokens"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"))
    failed = errors.groupBy(*keys).agg(F.count("*").alias("files_failed"))
    ps = percentiles(entries, keys, "tokens", {"p50": 0.5, "p90": 0.9})
    return ok.join(failed, keys, "full").join(ps, keys, "left").fillna(0, ["files_ok", "files_failed", "total_tokens"])


def failure_histogram(errors: DataFrame, code: Column) -> DataFrame:
    """``(code, n)``, the most frequent first; NULL counts as ``other``. The code is the refusal's own, without its details."""
    return errors.groupBy(F.coalesce(code, F.lit("other")).alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def coverage(ok: Column, total: Column) -> Column:
    """Percent with one decimal; 0.0 of nothing."""
    return F.when(total > 0, F.round(100.0 * ok / total, 1)).otherwise(F.lit(0.0))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of one row of logits and a 0-based target: log of the summed exponentials, less the target's logit."""
    xs = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.log(total) + top - F.get(xs, target)


def mean_loss(losses: Column) -> Column:
    """Over all rows; what a model of ``n`` equally likely tokens has is ln n."""
    return F.avg(losses)


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens a second; NULL for no time."""
    return F.try_divide(tokens.cast("double"), seconds.cast("double"))


def parameter_count(shapes: DataFrame) -> DataFrame:
    """``(n_parameters)`` of a table whose ``shape`` is the size of each tensor's axes; a scalar has one."""
    return shapes.agg(F.coalesce(F.sum(F.aggregate("shape", F.lit(1).cast("bigint"), lambda acc, n: acc * n)), F.lit(0)).cast("bigint").alias("n_parameters"))


def bigrams(sequences: DataFrame) -> DataFrame:
    """``(token, next, n, p)`` over all sequences: the table a model without context could learn at best. Pairs don't cross sequences."""
    pairs = sequences.where("size(tokens) > 1").select(F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b"))).alias("z"))
    counts = pairs.groupBy(F.col("z.a").alias("token"), F.col("z.b").alias("next")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("token").alias("_t")).agg(F.sum("n").alias("_all"))
    return counts.join(totals, F.col("token") == F.col("_t")).select("token", "next", "n", (F.col("n") / F.col("_all")).alias("p"))
