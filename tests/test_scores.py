
import pytest
from pyspark.sql import functions as F

from stavewright.functions import duration, exact, pitch
from stavewright.functions.fixed import BASE, FIRST, INSTRUMENTS, RATIOS, TYPES, vocabulary
from stavewright.functions.schema import SCORE, event
from stavewright.operators import layout, musicxml, sampling, score, stats, tokens
from stavewright.operators.ranking import prefix_sums
from stavewright.sources import corpus, dimensions
from stavewright.sources import musicxml as reader
from tests.scores import score as random_score


def frame(spark, scores):
    return spark.createDataFrame(scores, SCORE)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column).first()[0]


def test_vocabulary_is_frozen():
    v = vocabulary()
    assert len(v) == len(set(v)) == 666 and len(INSTRUMENTS) == 98 and len(FIRST) == 32
    pins = {0: "pad", 1: "bos", 3: "measure", 15: "key:0", 23: "time:1:1", 119: "clef:treble", 124: "instrument:soprano", 155: "instrument:percussion", 156: "part:0", 188: "pitch:C:-2:0", 502: "pitch:B:2:8", 503: "dur:breve:0", 526: "dur:64th:2", 527: "voice:1", 535: "instrument:clarinet_c", 601: "tuplet:3:2", 605: "dur:breve:3", 613: "tuplet:11:8", 616: "dur:128th:0", 620: "tuplet:2:1", 629: "dur:breve:4", 638: "tuplet:7:6", 648: "dur:256th:0", 653: "dur:long:0", 658: "clef:soprano", 665: "clef:french_violin"}
    assert all(v[i] == t for i, t in pins.items())


def test_encoding_agrees_with_the_vocabulary_and_decodes(spark):
    scores = [random_score(i) for i in range(40)]
    made = tokens.encode(frame(spark, scores)).select("score_key", "tokens", "error", tokens.tokens_of(F.col("parts")).alias("t")).collect()
    v = vocabulary()
    assert all(r.error is None and r.tokens[0] == 1 and r.tokens[-1] == 2 for r in made)
    assert all(v[t.id] == t.token for r in made for t in r.t)
    ids = spark.createDataFrame([(r.score_key, r.tokens) for r in made], "seq_id string, tokens array<int>")
    parts, measures, events = tokens.decode(ids)
    want_e = {(s["score_key"], p, m, i): tuple(e[c] for c in score._EVENT) for s in scores for p, part in enumerate(s["parts"]) for m, x in enumerate(part["measures"]) for i, e in enumerate(x["events"])}
    assert {(r.seq_id, r.part_idx, r.measure_idx, r.event_idx): tuple(r[c] for c in score._EVENT) for r in events.collect()} == want_e
    want_m = {(s["score_key"], p, m): (x["key"], x["beats"], x["beat_type"], x["clef"], m + 1) for s in scores for p, part in enumerate(s["parts"]) for m, x in enumerate(part["measures"])}
    assert {(r.seq_id, r.part_idx, r.measure_idx): (r.key_sig, r.beats, r.beat_type, r.clef, r.number) for r in measures.collect()} == want_m
    assert {(r.seq_id, r.part_idx): (r.instrument, r["name"]) for r in parts.collect()} == {(s["score_key"], i): (p["instrument"], p["name"]) for s in scores for i, p in enumerate(s["parts"])}


def test_a_part_named_twice_in_a_measure(spark):
    v = {t: i for i, t in enumerate(vocabulary())}
    ids = [v[t] for t in "bos instrument:flute measure part:0 rest dur:half:0 part:0 pitch:C:0:4 dur:half:0 tie_stop tie_start measure part:0 voice:2 rest dur:whole:0 tuplet:3:2 eos".split()]
    _, measures, events = tokens.decode(spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [9999])], "seq_id int, tokens array<int>"))
    assert [(r.measure_idx, r.number) for r in measures.orderBy("measure_idx").collect()] == [(0, 1), (1, 1), (2, 2)]
    assert [(r.measure_idx, r.kind, r.tie, r.voice, r.actual) for r in events.orderBy("measure_idx").collect()] == [(0, "rest", None, 1, None), (1, "note", "both", 1, None), (2, "rest", None, 2, 3)]


def test_facade_round_trip(spark):
    from stavewright import api

    scores = [random_score(200 + i) for i in range(12)] + [with_measure()]
    back = api.from_tokens(api.to_tokens(frame(spark, scores)))
    assert {r.score_key: r.parts for r in back.collect()} == {r.score_key: r.parts for r in frame(spark, scores).collect()}


def test_random_scores_survive_musicxml(spark):
    scores = [random_score(100 + i) for i in range(25)]
    for r in musicxml.to_musicxml(frame(spark, scores)).collect():
        want = next(s for s in scores if s["score_key"] == r.score_key)
        assert r.error is None and reader.parse(r.xml)["parts"] == want["parts"]


def with_measure(**m):
    base = {"number": 1, "key": None, "beats": None, "beat_type": None, "clef": None, "events": []}
    return {"score_key": "x", "title": None, "composer": None, "parts": [{"instrument": "flute", "name": "Flute", "transpose": None, "measures": [base | m]}], "error": None}


@pytest.mark.parametrize("made, code, detail", [
    (with_measure(beats=2, beat_type=3), "unsupported_time", "2:3"), (with_measure(key=9), "key_out_of_range", "9"), (with_measure(key=9, beats=2, beat_type=3), "key_out_of_range", "9"),
    (with_measure(events=[event("note", "quarter", 0, None, step="C", alter=3, octave=4)]), "unknown_token", "pitch:C:3:4"), (with_measure() | {"parts": with_measure()["parts"] * 33}, "too_many_parts", "33"), (with_measure() | {"parts": []}, "crash", "no parts"),
])
def test_refusals(spark, made, code, detail):
    r = tokens.encode(frame(spark, [made])).first()
    assert r.tokens is None and (r.error.code, r.error.detail) == (code, detail)


def test_a_score_without_measures_has_no_measure_tokens(spark):
    empty = with_measure()
    empty["parts"][0]["measures"] = []
    assert tokens.encode(frame(spark, [empty])).first().tokens == [1, 124 + 8, 2]


def test_pitch(spark):
    p = lambda *x: tuple(spark.range(1).select(*pitch.transpose(F.lit(x[0]), F.lit(x[1]), F.lit(x[2]), F.lit(x[3]), F.lit(x[4]))).first())
    assert p("C", 0, 4, 4, 7) == ("G", 0, 4) and p("C", 0, 4, -1, -2) == ("B", -1, 3) and p("C", 0, 4, 0, 1) == ("C", 1, 4) and p("B", 0, 4, 1, 1) == ("C", 0, 5) and p("F", 1, 4, 3, 5) == ("B", 0, 4)
    name = lambda d, c: spark.range(1).select(pitch.interval_name(F.lit(d), F.lit(c))).first()[0]
    assert [name(*x) for x in ((0, 0), (-1, -2), (4, 7), (-7, -12), (14, 24), (-8, -14), (-9, -15), (2, 2))] == ["unison", "M2 down", "P5 up", "1 octave down", "2 octaves up", "M2 + 1 octave down", "m3 + 1 octave down", "2d/2c up"]
    key = lambda k, d, c: spark.range(1).select(pitch.transpose_key(F.lit(k).cast("int"), F.lit(d), F.lit(c))).first()[0]
    assert key(None, 1, 2) is None and key(0, -1, -2) == -2 and key(7, 1, 2) == -3 and key(0, 7, 12) == 0 and key(-7, -1, -2) == 3
    way = lambda a, b, how: tuple(spark.range(1).select(*pitch.key_interval(F.lit(a), F.lit(b), how)).first())
    assert way(0, 6, "nearest") == (-4, -6) and way(0, 1, "up") == (4, 7) and way(0, 1, "nearest") == (-3, -5) and way(3, 3, "up") == (0, 0)
    with pytest.raises(ValueError):
        pitch.key_interval(F.lit(0), F.lit(1), "sideways")


def test_durations_agree_with_exact_arithmetic(spark):
    every = [(t, d, a, n) for t in TYPES for d in range(-1, 6) for a, n in [(None, None), *RATIOS]] + [("nonsense", 0, None, None), (None, 0, None, None)]
    df = spark.createDataFrame(every, "t string, d int, a int, n int")
    got = df.select("*", duration.divisions(F.col("t"), F.col("d"), F.col("a"), F.col("n")).alias("x")).collect()
    assert all(r.x == exact.divisions(r.t, r.d, (r.a, r.n) if r.a else None) for r in got) and sum(r.x is None for r in got if r.t in BASE and 0 <= r.d <= 4) > 20
    spans = [0, -1, 1, 360360, 7687680, 23063040 * 4 + 11531520, 5765760, 15375360 + 360360, 4612608, 3294720, 2562560, 2096640, 1774080, 1537536, *range(120120, 120120 * 400, 120120 * 7), *range(51480, 51480 * 300, 51480 * 11)]
    got = spark.createDataFrame([(s,) for s in spans], "s bigint").select("s", duration.decompose_rests(F.col("s")).alias("r"), duration.from_divisions(F.col("s")).alias("p")).collect()
    for r in got:
        want = exact.rests(r.s)
        assert (None if r.r is None else [(x.type, x.dots, (x.actual, x.normal) if x.actual else None) for x in r.r]) == want, r.s
        assert (tuple(r.p) if r.p else None) == exact.plain(r.s)
        assert want is None or sum(exact.divisions(t, d, q) for t, d, q in want) == r.s


def test_transposition(spark):
    df = frame(spark, [random_score(7)])
    before = score.events_of(df).orderBy("part_idx", "measure_idx", "event_idx").collect()
    assert score.events_of(score.by_interval(score.by_interval(df, 2, 3), -2, -3)).orderBy("part_idx", "measure_idx", "event_idx").collect() == before
    written = score.to_written(df, "clarinet")
    assert {(r.instrument, r["name"], r.transpose.diatonic) for r in score.parts_of(written).collect()} == {("clarinet", "Clarinet", -1)}
    assert "<transpose><diatonic>-1</diatonic><chromatic>-2</chromatic></transpose>" in musicxml.to_musicxml(written).first().xml
    back = score.to_concert(written, "clarinet")
    assert score.events_of(back).orderBy("part_idx", "measure_idx", "event_idx").collect() == before and score.parts_of(back).first().transpose is None
    violin = score.to_written(df, "violin")
    assert {r.instrument for r in score.parts_of(violin).collect()} == {"violin"} and score.to_concert(df, "violin") is df
    with pytest.raises(KeyError):
        score.to_written(df, "kazoo")
    assert {r.key_sig for r in score.measures_of(score.to_key(df, 2)).where("part_idx = 0 and measure_idx = 0").collect()} == {2}
    with pytest.raises(Exception, match="no key signature"):
        score.to_key(frame(spark, [with_measure()]), 2).collect()
    low = [event("note", "quarter", 0, None, step="C", alter=0, octave=1), event("rest", "quarter", 0, None), event("note", "quarter", 0, None, step="C", alter=0, octave=4)]
    assert [r.midi for r in score.out_of_range(score.events_of(frame(spark, [with_measure(events=low)])), "violin").collect()] == [24]
    assert score.out_of_range(score.events_of(df), "banjo").count() == 0
    both, problems = score.duet(df, "flute", "cello")
    assert [r.instrument for r in score.parts_of(both).orderBy("part_idx").collect()] == ["flute", "cello"] and problems.count() >= 0


def test_windows_and_sums(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [(None, 1, 5), (None, 2, None), ("b", 1, 1)], "k string, o int, v int")
    got = prefix_sums(df, ["k"], ["o"], F.col("v"), "s").collect()
    for r in got:
        assert r.s == sum((x.v or 0) for x in got if x.k == r.k and x.o < r.o)
    assert len(got) == 53 and prefix_sums(df.limit(0), ["k"], ["o"], F.col("v"), "s").count() == 0
    assert stats.percentiles(df.limit(0), [], "v", {"p": 0.5}).first().p is None
    w = sampling.next_token_windows(spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2]), (3, None), (4, [])], "seq_id int, tokens array<int>"), 2).orderBy("start").collect()
    assert [(r.seq_id, r.inputs, r.targets) for r in w] == [(1, [1, 2], [2, 3]), (1, [2, 3], [3, 4])]
    ids = spark.createDataFrame([(1, [0, 255, 256, 65535]), (2, []), (3, None)], "i int, t array<int>")
    packed = ids.select("i", sampling.pack_u16(F.col("t")).alias("b")).withColumn("t", sampling.unpack_u16(F.col("b"))).orderBy("i").collect()
    assert bytes(packed[0].b) == b"\x00\x00\xff\x00\x00\x01\xff\xff" and [r.t for r in packed] == [[0, 255, 256, 65535], [], None]
    with pytest.raises(ValueError):
        sampling.sample_with_replacement(df.limit(0), ["o"], 3, 1)


def test_sums_over_keys_that_span_ranges(spark):
    rows = [("hot", None, i, i % 7) for i in range(3000)] + [(None, "x", i, 1) for i in range(50)] + [("x", None, i, 2) for i in range(50)] + [(f"k{i}", "y", 0, 5) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, o int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small table is one range
    try:
        got = prefix_sums(df, ["a", "b"], ["o"], F.col("v"), "s").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    totals, want = {}, {}
    for a, b, o, v in sorted(rows, key=lambda r: (str(r[:2]), r[2])):
        want[a, b, o] = totals.get((a, b), 0)
        totals[a, b] = want[a, b, o] + v
    assert {(r.a, r.b, r.o): r.s for r in got} == want and len(got) == len(rows)


def test_what_does_not_pack_and_what_models_weigh(spark):
    ids = spark.createDataFrame([(1, [70000]), (2, [-1]), (3, [1, None]), (4, [7])], "i int, t array<int>")
    assert [r.b and bytes(r.b) for r in ids.select("i", sampling.pack_u16(F.col("t")).alias("b")).orderBy("i").collect()] == [None, None, None, b"\x07\x00"]
    shapes = spark.createDataFrame([([3, 4],), ([5],), ([],)], "shape array<bigint>")
    assert stats.parameter_count(shapes).first()[0] == 18 and stats.parameter_count(shapes.limit(0)).first()[0] == 0


def test_intermediate_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from stavewright.storage import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="a")))


def test_layout(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 3, 1, 1, 3, None, None])], "m int, o int, v int")
    assert [r.group_no for r in layout.voice_groups(df, ["m"], ["o"], "v").orderBy("o").collect()] == [0, 0, 1, 1, 2, 3, 3]
    assert [r.dense_voice for r in layout.renumber_by_appearance(df.where("v is not null"), ["m"], "o", "v").orderBy("o").collect()] == [1, 1, 2, 2, 1]
    e = [("3:2", 10), ("3:2", 0), (None, 5), ("3:2", BASE["quarter"] // 3), ("3:2", BASE["quarter"] * 2 // 3), ("3:2", 7), ("5:4", 7)]
    got = spark.createDataFrame([(e,)], "e array<struct<ratio:string,sounding:bigint>>").select(layout.tuplet_marks(F.col("e"))).first()[0]
    assert got == ["start", "stop", None, "start", "stop", "both", "both"]
    empty = spark.createDataFrame([([],)], "e array<struct<ratio:string,sounding:bigint>>").select(layout.tuplet_marks(F.col("e"))).first()[0]
    assert empty == []


def test_corpus_round_trip(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.krn").write_text("**kern\n4c\n4d\n*-\n")
    (tmp_path / "raw" / "b.krn").write_text("**kern\n17c\n*-\n")
    (tmp_path / "raw" / "c.krn").write_bytes(b"\xff\xfe")
    parsed = corpus.parse_scores(corpus.scan(spark, str(tmp_path / "raw"), "*.krn"), "path", F.lit("kern"))
    out = str(tmp_path / "out")
    corpus.write_corpus(parsed, out, "kern")
    index = corpus.load_index(spark, out).collect()
    assert [(r.key, r.byte_offset) for r in index] == [("a.krn", 0)]
    assert {r.code for r in spark.read.parquet(f"{out}/errors").collect()} == {"unsupported_tuplet", "crash"}
    assert spark.read.parquet(f"{out}/meta").first().vocab_size == 666
    assert len(corpus.read_sequence(spark, out, index[0].score_key).first().tokens) == index[0].tokens == 9
    from stavewright.streaming.ingest import start_ingest, stream_files

    q = start_ingest(stream_files(spark, str(tmp_path / "raw"), "*.krn"), "kern", str(tmp_path / "s"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s" / "tokens")).count() == 1 and spark.read.parquet(str(tmp_path / "s" / "errors")).count() == 2


def test_dimensions_and_rendering(spark):
    from stavewright.operators.render import available, render_pdf, render_svg

    assert dimensions.sources(spark).count() == 10 and dimensions.instruments(spark).where("transposition is not null").count() == 58 and dimensions.durations(spark).count() == 54
    assert corpus.download({"source": "none", "repository": None}, "/nonexistent") == "manual_download_required"
    found = spark.createDataFrame([("a/x.mscx",), ("a/y.mscx",), ("a/z.txt",)], "path string")
    assert [r.target_path for r in corpus.conversion_jobs(found, spark.createDataFrame([("musicxml/x.musicxml",)], "path string")).collect()] == ["musicxml/y.musicxml"]
    names = {r.name_key: r.instrument for r in dimensions.instrument_names(spark).collect()}
    assert (names["clarinet"], names["vlc"], names["clarinetineb"], names["horn"]) == ("clarinet", "cello", "clarinet_eb", "horn")
    if not available()["verovio"]:
        assert render_svg(spark.createDataFrame([("k", "<x/>")], "score_key string, xml string")).first().error == "renderer_not_found"
    if not available()["rsvg-convert"]:
        assert render_pdf(spark.createDataFrame([("k", "<x/>"), ("n", None)], "score_key string, xml string")).collect() == [("k", None, "renderer_not_found")]
