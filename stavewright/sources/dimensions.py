"""Small tables of fixed size: instruments, vocabulary, durations, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.functions.fixed import FIRST, INSTRUMENTS, TRANSPOSITIONS, plain_durations, vocabulary
from stavewright.functions.names import normalise

# The catalogue of public corpora. name|format|glob|subset list|repository|note
CATALOGUE = """
bach_chorales|kern|kern/*.krn||https://github.com/craigsapp/bach-370-chorales|four-part chorales
beethoven_quartets|kern|kern/*.krn||https://github.com/craigsapp/beethoven-string-quartets|string quartets
inventions|kern|kern/*.krn||https://github.com/humdrum-tools/inventions|two- and three-part inventions
wtc_fugues|kern|kern/*.krn||https://github.com/humdrum-tools/bach-wtc-fugues|fugues, a staff a part
haydn_quartets|kern|kern/*.krn||https://github.com/musedata/humdrum-haydn-quartets|quartet movements
mozart_quartets|kern|kern/*.krn||https://github.com/musedata/humdrum-mozart-quartets|quartet movements
polish_scores|kern|**/*.krn||https://github.com/pl-wnifc/humdrum-polish-scores|heritage 1600-1900
openscore_lieder|musicxml|musicxml/*.musicxml||https://github.com/OpenScore/Lieder|songs, converted from mscx first
openscore_quartets|musicxml|musicxml/*.musicxml||https://github.com/OpenScore/StringQuartets|quartets, converted from mscx first
pdmx|mxl|mxl/**/*.mxl|subset_paths/no_license_conflict.txt||manual download: Zenodo record 15571083
"""


def sources(spark: SparkSession) -> DataFrame:
    """A NULL repository must be downloaded by hand."""
    rows = [tuple(x or None for x in line.split("|")) for line in CATALOGUE.strip().split("\n")]
    return spark.createDataFrame([(*r, f"data/raw/{r[0]}", f"data/corpus/{r[0]}") for r in rows], "source string, format string, glob string, subset string, repository string, note string, raw_dir string, corpus_dir string")


def instruments(spark: SparkSession) -> DataFrame:
    """The roster in token order, with ``ord``, ``first`` (the frozen block) and the transposition's letters and semitones."""
    rows = [(i, i < len(FIRST), *x, *(TRANSPOSITIONS[x[6]] if x[6] else (None, None))) for i, x in enumerate(INSTRUMENTS)]
    return spark.createDataFrame(rows, "ord int, first boolean, instrument string, name string, family string, clef string, low_midi int, high_midi int, transposition string, aliases array<string>, diatonic int, chromatic int")


def instrument_names(spark: SparkSession) -> DataFrame:
    """``(name_key, instrument)``: every normalised name and alias; of two entries the earlier one has it."""
    every = instruments(spark).select("ord", "instrument", F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("n"))
    return every.groupBy(normalise(F.col("n")).alias("name_key")).agg(F.min_by("instrument", "ord").alias("instrument"))


def vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocabulary())), "token_id int, token string")


def durations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, d, n) for n, (t, d) in plain_durations().items()], "type string, dots int, divisions bigint")


def families(spark: SparkSession) -> DataFrame:
    """The families in the order the roster first names them."""
    return instruments(spark).groupBy("family").agg(F.min("ord").alias("ord")).orderBy("ord").select("family")


def instrument(spark: SparkSession, name: str) -> DataFrame:
    """All that is known of one instrument id; no rows for an unknown one."""
    return instruments(spark).where(F.col("instrument") == name)
