import zipfile

from stavewright import cli
from stavewright.plans import reference
from stavewright.sources import corpus

XML = '<score-partwise><part-list><score-part id="P1"><part-name>Flute</part-name></score-part></part-list><part id="P1"><measure number="1"><attributes><divisions>1</divisions></attributes><note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration><type>quarter</type></note></measure></part></score-partwise>'


def put(path, text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".mxl":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("score.xml", XML)
    else:
        path.write_text(text)


def built(spark, tmp_path, source):
    cli.main(["corpus", source, "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "out")])
    below = len(f"file:{tmp_path}/raw/{source}/")
    return sorted((r.score_key[below:], r.byte_offset) for r in corpus.load_index(spark, str(tmp_path / "out" / source)).collect())


def test_the_list_alone_decides(spark, tmp_path):
    raw = tmp_path / "raw" / "pdmx"
    for name in ("mxl/a/1 b+%20é.mxl", "mxl/a/2.mxl", "mxl/a/unlisted.mxl", "elsewhere/3.mxl", "elsewhere/4.mxl"):
        put(raw / name)
    put(raw / "subset_paths/no_license_conflict.txt", "./data/a/1 b+%20é.json\n\n./data/a/2.json\n./data/a/missing.json\nelsewhere/3.mxl\n./data/a/2.json\n")
    got = built(spark, tmp_path, "pdmx")
    assert [k for k, _ in got] == ["elsewhere/3.mxl", "mxl/a/1 b+%20é.mxl", "mxl/a/2.mxl", "mxl/a/2.mxl"]
    assert len({at for _, at in got}) == 4


def test_globs_hold_directories(spark, tmp_path):
    text = "**kern\n4c\n*-\n"
    for name in ("kern/a b+%20é[1].krn", "kern/deep/b.krn", "c.krn", "other/d.krn", "kern/e.KRN"):
        put(tmp_path / "raw" / "inventions" / name, text)
        put(tmp_path / "raw" / "polish_scores" / name, text)
    assert [k for k, _ in built(spark, tmp_path, "inventions")] == ["kern/a b+%20é[1].krn"]
    assert [k for k, _ in built(spark, tmp_path, "polish_scores")] == ["c.krn", "kern/a b+%20é[1].krn", "kern/deep/b.krn", "other/d.krn"]


def test_the_source_names_the_kind(spark, tmp_path):
    text = "**kern\n4c\n*-\n"
    files = [(1, "k", "a.krn", text), (2, "k", "a.KRN", text), (3, "k", "a.bak", text), (4, "x", "a.musicxml", XML), (5, "m", "a.MXL", XML), (6, "none", "a.krn", text), (7, None, "a.krn", text), (8, "k", "a.xml", XML), (9, "k", "b.krn", None)]
    spark.createDataFrame(files, "file_id bigint, source string, key string, content string").write.parquet(f"{tmp_path}/raw_files.parquet")
    spark.createDataFrame([("k", "kern"), ("x", "musicxml"), ("m", "mxl")], "source string, format string").write.parquet(f"{tmp_path}/sources.parquet")
    got = {int(r.score_key): r.code for r in reference.kern_ingest(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in got if i != 8} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: "unknown_format", 7: "unknown_format", 9: "empty"} and got[8] is not None


def test_status_and_statistics(spark, tmp_path):
    put(tmp_path / "raw" / "inventions" / "kern/a.krn", "**kern\n4c\n*-\n")
    put(tmp_path / "raw" / "inventions" / "kern/b.krn", "**kern\n17c\n*-\n")
    put(tmp_path / "raw" / "wtc_fugues" / "kern/a.krn", "**kern\n4c\n*-\n")
    assert built(spark, tmp_path, "inventions") == [("kern/a.krn", 0)]
    told = {r.source: (r.status, r.files, r.tokens) for r in cli.status(spark, f"{tmp_path}/raw", f"{tmp_path}/out").collect()}
    assert len(told) == 10 and told["inventions"] == ("built", 1, 7) and told["wtc_fugues"] == ("downloaded", None, None) and told["pdmx"] == ("missing", None, None)
    stats, refused = cli.built_stats(spark, f"{tmp_path}/out/inventions")
    row = stats.first()
    assert (row.files_ok, row.files_failed, row.total_tokens, row.p50, row.percent) == (1, 1, 7, 7, 50.0) and [tuple(r) for r in refused.collect()] == [("unsupported_tuplet", 1)]
    cli.main(["corpus", "--raw", f"{tmp_path}/raw", "--out", f"{tmp_path}/out"])
