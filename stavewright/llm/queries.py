"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.llm import chunking, leakage, mixing, names, neardup, packing, splits, unify
from stavewright.llm.oracle import ORACLES  # noqa: F401
from stavewright.storage import materialize

#: Tokens a container holds, shares of the splits, similarity of tokens.
CAPACITY = 2048
SHARES = {"train": 0.9, "validation": 0.05, "test": 0.05}
SIMILAR = 0.6


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.match_names(_table(spark, d, "score_parts"), _table(spark, d, "instruments"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members = mixing.member_sequences(_table(spark, d, "tokens_bin"), _table(spark, d, "entries"), _table(spark, d, "sources"))
    return mixing.mix(_table(spark, d, "mix_targets"), members)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Members that were taken in full, as often as allowed, and still fell short, by what the cube's selection holds of them."""
    return _mixed(spark, d)[1].where("used_tokens = max_repeats * n_tokens AND used_tokens < target_share * budget_tokens").select("mix_id", "member")


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """What is promised of every member of a mix: never more than its repeats allow, and its tokens right to within one sequence."""
    members = mixing.member_sequences(_table(spark, d, "tokens_bin"), _table(spark, d, "entries"), _table(spark, d, "sources"))
    selection, report = mixing.mix(_table(spark, d, "mix_targets"), members)
    longest = members.groupBy("by_field", "member").agg(F.max("n").alias("longest"))
    most = selection.groupBy("mix_id", "member").agg(F.max("copies").alias("most"))
    told = report.join(longest, ["by_field", "member"], "left").join(most, ["mix_id", "member"], "left")
    due = F.least(F.col("target_share") * F.col("budget_tokens"), (F.col("max_repeats") * F.col("n_tokens")).cast("double"))
    return told.select(
        "mix_id", "member", "n_docs", "n_tokens", "reachable", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
        (F.abs(F.col("used_tokens") - due) <= F.coalesce("longest", F.lit(0))).alias("share_kept"),
    )


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares each mix really reached."""
    return _mixed(spark, d)[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_table(spark, d, "tokens_bin"), t=SIMILAR)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    grouped = materialize(splits.groups(_table(spark, d, "scores")), "groups")
    several = grouped.groupBy("group_id").count().where("count > 1").select("group_id")
    return grouped.join(several, "group_id", "left_semi").select("score_id", "group_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every score with its group and split."""
    return splits.deal(materialize(splits.groups(_table(spark, d, "scores")), "groups"), SHARES)


def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    """What is promised of every split: its rows, within the largest group of what was asked, and none of its groups elsewhere."""
    dealt = materialize(p5_splits(spark, d), "dealt")
    groups = dealt.groupBy("group_id").agg(F.count("*").alias("size"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    largest, total, parted = groups.agg(F.max("size"), F.sum("size"), F.count_if(F.col("lo") != F.col("hi"))).first()
    counted = dealt.groupBy("split").count()
    asked = spark.createDataFrame(list(SHARES.items()), "split string, share double").join(counted, "split", "left")
    return asked.select("split", "share", F.lit(total).cast("bigint").alias("all_rows"), F.lit(largest).cast("bigint").alias("largest_group"), (F.abs(F.coalesce("count", F.lit(0)) - F.col("share") * F.lit(total)) <= F.lit(largest)).alias("kept"), F.lit(parted).cast("bigint").alias("parted_groups"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_sequences(_table(spark, d, "tokens_bin")).select("seq_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), CAPACITY).where("piece = 1").select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every notebook in its container."""
    return packing.pack(_table(spark, d, "documents"), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.lookalike_pairs(_table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same links in a row a document: its class of one form, and its exact spelling."""
    return unify.lookalike_classes(_table(spark, d, "documents"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same links between classes of equal sets: a row a sequence, with its class and how many other classes that is linked to."""
    classes, links = neardup.similar_classes(_table(spark, d, "tokens_bin"), SIMILAR)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return classes.join(degree, "class_id", "left").select("seq_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """What is promised of the containers: nothing lost, nothing over the capacity, nothing cut that fits, and no more of them than one above the least possible."""
    placed = materialize(packing.pack(_table(spark, d, "documents"), CAPACITY), "placed")
    load = placed.where("container is not null").groupBy("container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("load"))
    full = load.agg(F.count("*").alias("n"), F.coalesce(F.max("load"), F.lit(0)).alias("most"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"))
    docs = placed.groupBy("doc_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("held"), F.max("doc_tokens").alias("size"), F.count("*").alias("pieces"))
    kept = docs.agg(F.count("*").alias("n_docs"), F.count_if((F.col("held") != F.col("size")) | ((F.col("size") <= CAPACITY) & (F.col("pieces") > 1))).alias("n_wrong"))
    return full.crossJoin(kept).select("n_docs", "n_wrong", "tokens", (F.col("most") <= CAPACITY).alias("fits"), (F.col("n") <= F.ceil(F.col("tokens") / CAPACITY) + 1).alias("tight"))  # two single rows


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_shares, p3_balance, p4_found, p4_classes, p5_found, p5_splits, p5_balance, p6_found, p7_found, p7_containers, p7_fill, p8_found, p9_found, p9_classes)}
