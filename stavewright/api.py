"""The engine in a few calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.operators import score, tokens
from stavewright.operators.musicxml import to_musicxml
from stavewright.operators.render import render_svg
from stavewright.sources.corpus import ingest, load_index, parse_scores, read_sequence, scan, scan_files, write_corpus

__all__ = ["from_kern", "from_musicxml", "from_tokens", "ingest", "load_index", "parse_scores", "read_sequence", "render_svg", "scan", "scan_files", "to_musicxml", "to_tokens", "write_corpus"]


def from_musicxml(documents: DataFrame, key: str = "score_key", content: str = "content") -> DataFrame:
    return parse_scores(documents, key, F.lit("musicxml"), content)


def from_kern(texts: DataFrame, key: str = "score_key", content: str = "content") -> DataFrame:
    return parse_scores(texts, key, F.lit("kern"), content)


def to_tokens(scores: DataFrame) -> DataFrame:
    """``(score_key, tokens, error)``."""
    return tokens.encode(scores).select("score_key", "tokens", "error")


def from_tokens(sequences: DataFrame, key: str = "score_key") -> DataFrame:
    """Rows of SCORE from ``(key, tokens)``: names are the registry's, measures count from 1, title and composer are lost."""
    parts, measures, events = (x.withColumnRenamed(key, "score_key") for x in tokens.decode(sequences, key))
    return score.assemble(parts.withColumn("transpose", F.lit(None).cast("struct<diatonic:int,chromatic:int>")), measures, events)
