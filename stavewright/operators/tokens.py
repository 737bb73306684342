"""Scores to token ids and back.

Encoding works on the nested row of a score, inside one JVM expression: no shuffle and
no vocabulary join, because an id follows from its token's fields by block arithmetic.
Decoding reads each sequence where it lies, as arrays, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavewright.functions.fixed import CANONICAL_RATIOS, CLEFS, EXTENDED_RATIOS, FIRST, INSTRUMENTS, LATER_RATIOS, MAX_PARTS, MAX_VOICES, STEPS, TYPES, vocabulary
from stavewright.functions.pitch import step_index
from stavewright.sources.dimensions import vocab
from stavewright.storage import ship


def _place(values: list, x: Column) -> Column:
    """0-based place of ``x`` in ``values``, NULL if it isn't there."""
    i = F.array_position(F.array(*map(F.lit, values)), x).cast("int")
    return F.when(i > 0, i - 1)


def _text(*xs: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("?")) for x in xs])


def _token(token: Column, token_id: Column | int) -> Column:
    return F.struct(token.alias("token"), (F.lit(token_id) if isinstance(token_id, int) else token_id).cast("int").alias("id"))


def _fixed(token: str, token_id: int) -> Column:
    return _token(F.lit(token), token_id)


def _instrument(i: Column) -> Column:
    at = _place([x[0] for x in INSTRUMENTS], i)
    return _token(_text("instrument", i), F.when(at < len(FIRST), 124 + at).otherwise(535 - len(FIRST) + at))


def _key(k: Column) -> Column:
    return _token(_text("key", k), F.when(k.between(-7, 7), 15 + k))


def _time(n: Column, d: Column) -> Column:
    return _token(_text("time", n, d), F.when(n.between(1, 16), 23 + (n - 1) * 6 + _place([1, 2, 4, 8, 16, 32], d)))


def _clef(c: Column) -> Column:
    at = _place(list(CLEFS), c)
    return _token(_text("clef", c), F.when(at < 5, 119 + at).otherwise(653 + at))


def _pitch(step: Column, alter: Column, octave: Column) -> Column:
    return _token(_text("pitch", step, alter, octave), F.when(octave.between(0, 8) & alter.between(-2, 2), 188 + octave * 35 + step_index(step) * 5 + alter + 2))


def _duration(kind: Column, dots: Column) -> Column:
    t = _place(TYPES, kind)
    number = (
        F.when((t < 8) & dots.between(0, 2), 503 + 3 * t + dots)
        .when((t < 8) & (dots == 3), 605 + t)
        .when((t == 8) & dots.between(0, 3), 616 + dots)
        .when((t <= 8) & (dots == 4), 629 + t)
        .when((t > 8) & dots.between(0, 4), 648 + 5 * (t - 9) + dots)
    )
    return _token(_text("dur", kind, dots), number)


def _voice(v: Column) -> Column:
    return _token(_text("voice", v), F.when(v.between(1, MAX_VOICES), 526 + v))


def _tuplet(actual: Column, normal: Column) -> Column:
    written = F.concat_ws(":", actual, normal)
    number = F.lit(None).cast("int")
    for first, ratios in ((601, CANONICAL_RATIOS[:4]), (613, CANONICAL_RATIOS[4:]), (620, EXTENDED_RATIOS), (638, LATER_RATIOS)):
        number = F.coalesce(number, first + _place([f"{a}:{n}" for a, n in ratios], written))
    return _token(_text("tuplet", actual, normal), number)


def _none() -> Column:
    return F.array().cast("array<struct<token:string,id:int>>")


def _if(condition: Column, *tokens: Column) -> Column:
    return F.when(condition, F.array(*tokens)).otherwise(_none())


def _event(e: Column, before: Column) -> Column:
    """The tokens of an event; ``before`` is the voice of the one before it, 0 at the start of a measure."""
    note = e["kind"] == "note"
    return F.concat(
        # Voice 1 is understood.
        _if((e["voice"] != before) & (e["voice"] != 1), _voice(e["voice"])),
        _if(note & e["chord"], _fixed("chord", 4)),
        F.array(F.when(note, _pitch(e["step"], e["alter"], e["octave"])).otherwise(_fixed("rest", 7)), _duration(e["dur_type"], e["dots"])),
        _if(e["actual"].isNotNull(), _tuplet(e["actual"], e["normal"])),
        _if(note & F.coalesce(e["tie"], F.lit("")).isin("stop", "both"), _fixed("tie_stop", 6)),
        _if(note & F.coalesce(e["tie"], F.lit("")).isin("start", "both"), _fixed("tie_start", 5)),
    )


def _measure(m: Column) -> Column:
    events = m["events"]
    voices = F.transform(events, lambda e: e["voice"])
    before = F.concat(F.array(F.lit(0)), F.slice(voices, F.lit(1), F.greatest(F.size(events) - 1, F.lit(0))))
    attributes = F.concat(_if(m["key"].isNotNull(), _key(m["key"])), _if(m["beats"].isNotNull(), _time(m["beats"], m["beat_type"])), _if(m["clef"].isNotNull(), _clef(m["clef"])))
    return F.concat(attributes, F.when(F.size(events) > 0, F.flatten(F.zip_with(events, before, _event))).otherwise(_none()))


def tokens_of(parts: Column) -> Column:
    """``array<struct<token, id>>`` of a score's parts; ``id`` is NULL where the vocabulary has none.

    ``bos instrument+ (measure (part attributes events)*)* eos``, measure by measure
    across parts; shorter parts drop out early. A score without measures has none.
    """
    longest = F.coalesce(F.array_max(F.transform(parts, lambda p: F.size(p["measures"]))), F.lit(0))
    column = lambda m: F.flatten(F.transform(parts, lambda p, i: F.when(m < F.size(p["measures"]), F.concat(F.array(_token(_text("part", i), F.when(i < MAX_PARTS, 156 + i))), _measure(F.get(p["measures"], m)))).otherwise(_none())))
    body = F.when(longest > 0, F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), lambda m: F.concat(F.array(_fixed("measure", 3)), column(m))))).otherwise(_none())
    return F.concat(F.array(_fixed("bos", 1)), F.transform(parts, lambda p: _instrument(p["instrument"])), body, F.array(_fixed("eos", 2)))


def encode(scores: DataFrame) -> DataFrame:
    """Rows of SCORE with ``tokens`` (array<int>, NULL if refused) and ``error`` (what was there, else the refusal).

    Too many parts come first, then the first token the vocabulary lacks, in sequence
    order. A score without parts can't be encoded (code ``crash``).
    """
    made = scores.withColumn("_t", F.when(F.col("error").isNull() & (F.size("parts") > 0) & (F.size("parts") <= MAX_PARTS), tokens_of(F.col("parts"))))
    bad = F.get(F.filter("_t", lambda t: t["id"].isNull()), F.lit(0))["token"]
    tag = F.substring_index(bad, ":", 1)
    refusal = lambda code, detail: F.struct(code.alias("code"), detail.cast("string").alias("detail"))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce(F.size("parts"), F.lit(0)) < 1, refusal(F.lit("crash"), F.lit("no parts")))
        .when(F.size("parts") > MAX_PARTS, refusal(F.lit("too_many_parts"), F.size("parts")))
        .when(bad.isNotNull(), refusal(F.when(tag == "time", F.lit("unsupported_time")).when(tag == "key", F.lit("key_out_of_range")).otherwise(F.lit("unknown_token")), F.when(tag.isin("time", "key"), F.substring(bad, F.length(tag) + 2, 1 << 30)).otherwise(bad)))
    )
    return made.withColumn("tokens", F.when(error.isNull(), F.transform("_t", lambda t: t["id"]))).withColumn("error", error).drop("_t")


def spell(tokens: DataFrame) -> DataFrame:
    """``(.., token_id)`` joined with its ``token`` (NULL for an id the vocabulary lacks); the vocabulary has 666 rows."""
    return tokens.join(F.broadcast(vocab(tokens.sparkSession)), "token_id", "left")


_NONE = -1


@cache
def _tables() -> dict[str, np.ndarray]:
    """For each id its tag (place in _TAGS, the last for an id without a token) and up to three numbers: places in lists where the token has words."""
    listed = {"step": STEPS, "clef": list(CLEFS), "instrument": [x[0] for x in INSTRUMENTS], "dur": TYPES}
    tokens = vocabulary()
    tag, numbers = np.full(len(tokens) + 1, len(_TAGS), dtype=np.int8), np.full((3, len(tokens) + 1), _NONE, dtype=np.int64)
    for i, token in enumerate(tokens):
        head, *rest = token.split(":")
        tag[i] = _TAGS.index(head)
        for j, x in enumerate(rest):
            words = listed.get("step" if head == "pitch" else head)
            numbers[j, i] = words.index(x) if j == 0 and words else int(x)
    return {"tag": tag, "numbers": numbers}


_TAGS = ["pad", "bos", "eos", "measure", "chord", "tie_start", "tie_stop", "rest", "key", "time", "clef", "instrument", "part", "pitch", "dur", "voice", "tuplet"]
_OF = {t: i for i, t in enumerate(_TAGS)}


def _since(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The place of the last flagged position up to each one, _NONE if it lies before ``start``."""
    last = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), _NONE))
    return np.where(last >= start, last, _NONE)


def _decode_one(ids: np.ndarray) -> dict[str, list]:
    """Parts, measures and events of one sequence, as arrays of numbers."""
    t = _tables()
    size = t["numbers"].shape[1] - 1
    ids = np.where((ids >= 0) & (ids < size), ids, size)
    tag, (a1, a2, a3) = t["tag"][ids], t["numbers"][:, ids]
    at = np.arange(len(ids))
    number = np.cumsum(tag == _OF["measure"])
    opens = (tag == _OF["measure"]) | (tag == _OF["part"])
    start = np.maximum.accumulate(np.where(opens, at, _NONE))  # where its column begins
    inside = (start >= 0) & (tag[start] == _OF["part"])
    out = {"instruments": a1[tag == _OF["instrument"]]}

    begins = np.flatnonzero(inside & opens)  # columns with a part: a measure each
    column = np.cumsum(inside & opens) - 1
    part = a1[begins]
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], part[order])
    measure_idx = np.empty(len(begins), dtype=np.int64)
    measure_idx[order] = np.arange(len(begins)) - first
    measure = {"part_idx": part, "measure_idx": measure_idx, "number": number[begins]}
    for name, source, values in (("key_sig", "key", a1), ("beats", "time", a1), ("beat_type", "time", a2), ("clef", "clef", a1)):
        measure[name] = np.full(len(begins), _MISSING)
        some = np.flatnonzero(inside & (tag == _OF[source]))
        measure[name][column[some]] = values[some]  # the last one holds
    out["measures"] = measure

    head = inside & ((tag == _OF["pitch"]) | (tag == _OF["rest"]))
    heads = np.flatnonzero(head)
    event = np.cumsum(head) - 1
    begun = inside & (_since(head, start) >= 0)
    voice = _since(tag == _OF["voice"], start)
    made = {"column": column[heads], "rest": tag[heads] == _OF["rest"], "step": a1[heads], "alter": a2[heads], "octave": a3[heads]}
    made["voice"] = np.where(voice[heads] >= 0, a1[voice[heads]], 1)
    made["chord"] = (heads > 0) & (tag[heads - 1] == _OF["chord"])
    for name, source, values in (("dur_type", "dur", a1), ("dots", "dur", a2), ("actual", "tuplet", a1), ("normal", "tuplet", a2)):
        made[name] = np.full(len(heads), _MISSING)
        some = np.flatnonzero(begun & (tag == _OF[source]))
        made[name][event[some]] = values[some]
    for name in ("tie_start", "tie_stop"):
        made[name] = np.zeros(len(heads), dtype=bool)
        made[name][event[begun & (tag == _OF[name])]] = True
    made["event_idx"] = np.arange(len(heads)) - np.searchsorted(made["column"], made["column"])
    out["events"] = made
    return out


_MISSING = -(1 << 31)


def decode(sequences: DataFrame, key: str = "seq_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(parts, measures, events)``, long, of sequences ``(key, tokens)``.

    The ``number`` of a token's measure is that of ``measure`` tokens so far; its part is
    the last ``part`` since then (a part named twice in a measure has two measures of
    that number; ``measure_idx`` counts a part's own), its voice the last ``voice`` since the part (else 1); an
    event begins at ``pitch`` or ``rest``, and durations, tuplets and ties belong to
    the last one, of several the last holds. ``stop`` and ``start`` on one event are
    ``both``. Tokens outside any part, and ids without a token, say nothing. NULL and
    empty sequences decode to no rows. Sequences are decoded where they lie, without a
    shuffle, each as a whole.
    """
    ship(sequences.sparkSession)
    field = next(f for f in sequences.schema if f.name == key)
    shapes = {
        "parts": "part_idx int, instrument string, name string", "measures": "part_idx int, measure_idx int, number int, key_sig int, beats int, beat_type int, clef string",
        "events": "part_idx int, measure_idx int, number int, event_idx int, kind string, step string, alter int, octave int, dur_type string, dots int, tie string, chord boolean, voice int, actual int, normal int",
    }

    def table(what: str) -> DataFrame:
        schema = T.StructType([T.StructField(key, field.dataType), *T.StructType.fromDDL(shapes[what])])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = {x[0]: x[1] for x in INSTRUMENTS}
            clefs, instruments_ = list(CLEFS), [x[0] for x in INSTRUMENTS]
            word = lambda xs, words: pa.array(np.append(np.array(words, dtype=object), None)[np.where(xs < 0, len(words), xs)], pa.string())
            whole = lambda xs: pa.array(xs.astype(np.int32), mask=xs == _MISSING)
            for batch in batches:
                lists = batch.column(1)
                made, rows = [], []
                for ids in lists:
                    one = _decode_one(ids.values.fill_null(_NONE).to_numpy(zero_copy_only=False)) if ids.is_valid and len(ids.values) else None
                    if what == "events" and one:
                        e, m = one["events"], one["measures"]
                        one = e | {x: m[x][e["column"]] for x in ("part_idx", "measure_idx", "number")}
                    elif one:
                        one = one["measures"] if what == "measures" else {"instrument": one["instruments"]}
                    made.append(one)
                    rows.append(len(next(iter(one.values()))) if one else 0)
                some = [x for x in made if x]
                c = {n: np.concatenate([x[n] for x in some]) for n in some[0]} if some else None
                if not c or not sum(rows):
                    continue
                owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                if what == "parts":
                    spelt = word(c["instrument"], instruments_)
                    columns = [whole(np.concatenate([np.arange(n) for n in rows])), spelt, pa.array([names[x] for x in spelt.to_pylist()])]
                elif what == "measures":
                    columns = [whole(c[n]) for n in ("part_idx", "measure_idx", "number", "key_sig", "beats", "beat_type")] + [word(c["clef"], clefs)]
                else:
                    sounding = lambda xs: whole(np.where(c["rest"], _MISSING, xs))
                    columns = [whole(c[n]) for n in ("part_idx", "measure_idx", "number", "event_idx")]
                    columns += [word(np.where(c["rest"], 0, 1), ["rest", "note"]), word(np.where(c["rest"], _NONE, c["step"]), STEPS), sounding(c["alter"]), sounding(c["octave"])]
                    columns += [word(c["dur_type"], TYPES), whole(c["dots"]), word(c["tie_start"] * 1 + c["tie_stop"] * 2 - 1, ["start", "stop", "both"]), pa.array(c["chord"])]
                    columns += [whole(c[n]) for n in ("voice", "actual", "normal")]
                yield pa.RecordBatch.from_arrays([owner, *columns], schema.names)

        return sequences.select(key, "tokens").mapInArrow(run, schema)

    return table("parts"), table("measures"), table("events")
