"""Whole scores as relations: nested rows to long tables and back, transposition, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavewright.functions import pitch
from stavewright.functions.schema import EVENT, MEASURE, PART, REFUSAL
from stavewright.sources.dimensions import instruments

_EVENT = ["kind", "step", "alter", "octave", "dur_type", "dots", "tie", "chord", "voice", "actual", "normal"]


def parts_of(scores: DataFrame) -> DataFrame:
    return scores.select("score_key", F.posexplode("parts").alias("part_idx", "p")).select("score_key", "part_idx", "p.instrument", "p.name", "p.transpose")


def measures_of(scores: DataFrame) -> DataFrame:
    """A row a measure, empty ones too; the key signature is ``key_sig``."""
    m = scores.select("score_key", F.posexplode("parts").alias("part_idx", "p")).select("score_key", "part_idx", F.posexplode("p.measures").alias("measure_idx", "m"))
    return m.select("score_key", "part_idx", "measure_idx", "m.number", F.col("m.key").alias("key_sig"), "m.beats", "m.beat_type", "m.clef")


def events_of(scores: DataFrame) -> DataFrame:
    m = scores.select("score_key", F.posexplode("parts").alias("part_idx", "p")).select("score_key", "part_idx", F.posexplode("p.measures").alias("measure_idx", "m"))
    return m.select("score_key", "part_idx", "measure_idx", "m.number", F.posexplode("m.events").alias("event_idx", "e")).select("score_key", "part_idx", "measure_idx", "number", "event_idx", "e.*")


def assemble(parts: DataFrame, measures: DataFrame, events: DataFrame) -> DataFrame:
    """Long tables (as :func:`parts_of` and the others give them) to rows of SCORE.

    Measures without events and parts without measures stay; order is that of the
    ``_idx`` columns. Groups are a measure, a part, a score: bounded by a file.
    """
    listed = lambda order, item: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), item.alias("x")))), lambda s: s["x"])
    e = events.groupBy("score_key", "part_idx", "measure_idx").agg(listed("event_idx", F.struct(*_EVENT)).alias("events"))
    m = measures.join(e, ["score_key", "part_idx", "measure_idx"], "left").withColumn("events", F.coalesce("events", F.array().cast(f"array<{EVENT}>")))
    m = m.groupBy("score_key", "part_idx").agg(listed("measure_idx", F.struct("number", F.col("key_sig").alias("key"), "beats", "beat_type", "clef", "events")).alias("measures"))
    p = parts.join(m, ["score_key", "part_idx"], "left").withColumn("measures", F.coalesce("measures", F.array().cast(f"array<{MEASURE}>")))
    return p.groupBy("score_key").agg(listed("part_idx", F.struct("instrument", "name", "transpose", "measures")).alias("parts")).select(
        "score_key", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("composer"), F.col("parts").cast(f"array<{PART}>").alias("parts"), F.lit(None).cast(REFUSAL).alias("error")
    )


def _over_notes(parts: Column, change) -> Column:
    """``parts`` with ``change(part, measure, event) -> event`` applied inside the nested row: no shuffle."""
    return F.transform(parts, lambda p: p.withField("measures", F.transform(p["measures"], lambda m: m.withField("events", F.transform(m["events"], lambda e: change(p, m, e))))))


def _moved(parts: Column, letters: Column, semitones: Column) -> Column:
    def change(_p: Column, _m: Column, e: Column) -> Column:
        step, alter, octave = pitch.transpose(e["step"], e["alter"], e["octave"], letters, semitones)
        return F.when(e["kind"] == "note", e.withField("step", step).withField("alter", alter).withField("octave", octave)).otherwise(e)

    keyed = F.transform(parts, lambda p: p.withField("measures", F.transform(p["measures"], lambda m: m.withField("key", pitch.transpose_key(m["key"], letters, semitones)))))
    return _over_notes(keyed, change)


def by_interval(scores: DataFrame, letters: int, semitones: int) -> DataFrame:
    """Pitches and key signatures moved by one interval; rests and NULL keys stay."""
    return scores.withColumn("parts", _moved(F.col("parts"), F.lit(letters), F.lit(semitones)))


def _registry(scores: DataFrame, instrument: str):
    row = instruments(scores.sparkSession).where(F.col("instrument") == instrument).first()  # the roster has 98 rows
    if row is None:
        raise KeyError(f"no instrument {instrument!r}")
    return row


def to_written(scores: DataFrame, instrument: str) -> DataFrame:
    """Concert pitch as a player of ``instrument`` reads it; parts take its id and name, and its transposition if it has one."""
    row = _registry(scores, instrument)
    parts = F.col("parts")
    if row.transposition:
        parts = F.transform(_moved(parts, F.lit(-row.diatonic), F.lit(-row.chromatic)), lambda p: p.withField("transpose", F.struct(F.lit(row.diatonic).alias("diatonic"), F.lit(row.chromatic).alias("chromatic"))))
    return scores.withColumn("parts", F.transform(parts, lambda p: p.withField("instrument", F.lit(instrument)).withField("name", F.lit(row["name"]))))


def to_concert(scores: DataFrame, instrument: str) -> DataFrame:
    """The inverse: sounding pitch, no transposition; names stay. Concert instruments change nothing."""
    row = _registry(scores, instrument)
    if not row.transposition:
        return scores
    return scores.withColumn("parts", F.transform(_moved(F.col("parts"), F.lit(row.diatonic), F.lit(row.chromatic)), lambda p: p.withField("transpose", F.lit(None).cast("struct<diatonic:int,chromatic:int>"))))


def first_key(parts: Column) -> Column:
    """The first key signature stated, part by part, then measure by measure; 0 counts. NULL if none is."""
    keys = F.flatten(F.transform(parts, lambda p: F.filter(F.transform(p["measures"], lambda m: m["key"]), lambda k: k.isNotNull())))
    return F.get(keys, F.lit(0))


def to_key(scores: DataFrame, goal: int, direction: str = "nearest") -> DataFrame:
    """Every score moved from its first key to ``goal``; a score that states none fails the query."""
    keys = scores.sparkSession.range(-60, 61).select(F.col("id").cast("int").alias("k"))
    # Looked up: one interval a key, and no score has more sharps.
    ways = keys.select("k", F.struct(*[x.alias(n) for x, n in zip(pitch.key_interval(F.col("k"), F.lit(goal), direction), "dc")]).alias("w"))
    known = scores.withColumn("_from", F.coalesce(first_key(F.col("parts")), F.raise_error(F.lit("a score states no key signature to transpose from")).cast("int")))
    known = known.join(F.broadcast(ways), F.col("_from") == F.col("k"), "left")
    return known.withColumn("parts", _moved(F.col("parts"), F.col("w")["d"], F.col("w")["c"])).drop("_from", "k", "w")


def in_range(midi: Column, low: Column, high: Column) -> Column:
    """Instruments without a range play everything."""
    return F.coalesce(midi.between(low, high), F.lit(True))


def out_of_range(events: DataFrame, instrument: str) -> DataFrame:
    """The notes of long ``events`` that ``instrument`` can't play; rests never are."""
    row = _registry(events, instrument)
    midi = pitch.midi(F.col("step"), F.col("alter"), F.col("octave"))
    low, high = (F.lit(x).cast("int") for x in (row.low_midi, row.high_midi))
    return events.where((F.col("kind") == "note") & ~in_range(midi, low, high)).withColumn("midi", midi)


def duet(scores: DataFrame, upper: str, lower: str) -> tuple[DataFrame, DataFrame]:
    """The outer parts arranged for two instruments, and the notes either can't play."""
    outer = lambda i: scores.withColumn("parts", F.array(F.element_at("parts", i)))
    top, low = outer(1), outer(-1)
    problems = out_of_range(events_of(top), upper).withColumn("part_idx", F.lit(0)).unionByName(out_of_range(events_of(low), lower).withColumn("part_idx", F.lit(1)))
    written = to_written(top, upper).select("score_key", "title", "composer", F.col("parts").alias("a")).join(to_written(low, lower).select("score_key", F.col("parts").alias("b")), "score_key")
    return written.select("score_key", "title", "composer", F.concat("a", "b").alias("parts")), problems
