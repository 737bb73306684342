"""Queries over whole scores, each with SQL that says field by field what must come out.

The scores are written from rows of ``part``, one a row: kern or MusicXML text whose key,
meter, pitches, durations and faults follow from ``p_partkey``. The SQL never sees the text.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.operators import musicxml as writer
from stavewright.operators import score, tokens
from stavewright.sources import corpus
from stavewright.storage import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS i")


# --- kern -----------------------------------------------------------------------------------------------------------

# Two parts and a companion spine, two measures: remarks, attributes, a chord, ties, tuplets, a rest, a grace note, null
# tokens, a split and a merge.
_KERN = r"""
concat_ws('\n',
  concat('!!!COM: Composer ', i), concat('!!!OTL@EN:  Title ', i), '**kern\t**dynam\t**kern', '*I"Bass\t*\t*Ivioln', '*clefF4\t*\t*clefG2', concat('*k[', k, ']\t*\t*k[', k, ']'),
  concat('*M', 1 + i % 12, '/', element_at(array('1', '2', '4', '8', '16'), cast(1 + i % 5 AS int)), '\t*\t*MM90'), '! a remark\t!\t!',
  concat('4C\tf\t[', r, '.', n, ' ', r, 'e'), concat('4r\t.\t', r, n, ']'), '8qd\t.\t.', '=2\t=2\t=2',
  '*^\t*\t*', '2D\t2F\tp\t4g', '4E\t.\t.\t4a', '*v\t*v\t*\t*', '=\t=\t=', '*-\t*-\t*-')
"""


def kern_cases(spark: SparkSession, d: str) -> DataFrame:
    """``(i, content)``: a kern text a row of ``part``."""
    parts = _numbers(spark, d).selectExpr(
        "i", "substr(if(i % 2 = 0, 'f#c#g#d#a#e#b#', 'b-e-a-d-g-c-f-'), 1, cast(2 * (i % 8) AS int)) AS k", "element_at(array('1', '2', '4', '8', '16', '32', '12', '24', '40', '6'), cast(1 + i % 10 AS int)) AS r",
        "concat(repeat(substr('cdefgab', cast(1 + i % 7 AS int), 1), cast(1 + i % 3 AS int)), element_at(array('', '#', '-', '##'), cast(1 + i % 4 AS int))) AS n",
    )
    return parts.selectExpr("i", f"{_KERN} AS content")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return corpus.parse_scores(kern_cases(spark, d), "i", F.lit("kern"))


def flat(scores: DataFrame) -> DataFrame:
    """A row an event, with all that its measure, part and score say."""
    p = scores.select(F.col("score_key").cast("bigint").alias("i"), "title", "composer", F.posexplode("parts").alias("part_idx", "p"))
    m = p.select("i", "title", "composer", "part_idx", "p.instrument", "p.name", "p.transpose.diatonic", "p.transpose.chromatic", F.explode("p.measures").alias("m"))
    m = m.select(*m.columns[:-1], "m.number", F.col("m.key").alias("key_sig"), "m.beats", "m.beat_type", "m.clef", F.posexplode("m.events").alias("event_idx", "e"))
    return m.select(*m.columns[:-1], "e.*")


_EVENTS = """
p as (select p_partkey as i, (p_partkey % 8) * (case when p_partkey % 2 = 0 then 1 else -1 end) as k, 'CDEFGAB'[1 + p_partkey % 7] as s, [0, 1, -1, 2][1 + p_partkey % 4] as a, 4 + p_partkey % 3 as o,
  ['whole', 'half', 'quarter', 'eighth', '16th', '32nd', 'eighth', '16th', '32nd', 'quarter'][1 + p_partkey % 10] as t, case p_partkey % 10 when 6 then 3 when 7 then 3 when 9 then 3 when 8 then 5 end as x, case p_partkey % 10 when 6 then 2 when 7 then 2 when 9 then 2 when 8 then 4 end as y from part),
ev0 as (
  select i, 0 as part_idx, 1 as number, 0 as event_idx, 'note' as kind, s as step, a as alter, o as octave, t as dur_type, 1 as dots, 'start' as tie, false as chord, 1 as voice, x as actual, y as normal from p
  union all select i, 0, 1, 1, 'note', 'E', 0, 4, t, 0, null, true, 1, x, y from p
  union all select i, 0, 1, 2, 'note', s, a, o, t, 0, 'stop', false, 1, x, y from p
  union all select i, v.* from p, (values (1, 1, 0, 'note', 'C', 0, 3, 'quarter', 0, null, false, 1, null, null), (1, 1, 1, 'rest', null, null, null, 'quarter', 0, null, false, 1, null, null),
    (0, 2, 0, 'note', 'G', 0, 4, 'quarter', 0, null, false, 1, null, null), (0, 2, 1, 'note', 'A', 0, 4, 'quarter', 0, null, false, 1, null, null),
    (1, 2, 0, 'note', 'D', 0, 3, 'half', 0, null, false, 1, null, null), (1, 2, 1, 'note', 'E', 0, 3, 'quarter', 0, null, false, 1, null, null), (1, 2, 2, 'note', 'F', 0, 3, 'half', 0, null, false, 2, null, null)) as v),
ev as (select e.*, case when number = 1 then p.k end as key_sig, case when number = 1 and part_idx = 1 then 1 + i % 12 end as beats, case when number = 1 and part_idx = 1 then [1, 2, 4, 8, 16][1 + i % 5] end as beat_type,
  case when number = 1 then case part_idx when 0 then 'treble' else 'bass' end end as clef from ev0 e join p using (i))
"""
_PLACE = ", ".join(f"cast({c} as integer) as {c}" for c in ("part_idx", "number", "event_idx", "alter", "octave", "dots", "voice", "actual", "normal", "key_sig", "beats", "beat_type"))
_WORDS = "i, kind, step, dur_type, tie, chord, clef"
_SAME = "case part_idx when 0 then 'violin' else 'bass' end as instrument, case part_idx when 0 then 'Violin' else 'Bass' end as name"
_FREE = "cast(null as integer) as diatonic, cast(null as integer) as chromatic"
_NAMED = "'Title ' || i as title, 'Composer ' || i as composer"


@_query(f"with {_EVENTS} select {_WORDS}, {_PLACE}, {_SAME}, {_FREE}, {_NAMED} from ev")
def kern_fields(spark, d):
    """S6 N1..N25 J5 J6 W8 A9 O4 P6 P7 P8: every field that a kern file states, of files that open with remarks."""
    return flat(_scores(spark, d))


@_query(f"with {_EVENTS} select {_WORDS}, {_PLACE}, {_SAME}, {_FREE}, {_NAMED} from ev")
def xml_round_trip(spark, d):
    """K3 X1..X8 S7 M1..M19 F24 A7 A10 J6 R8: scores written as MusicXML and read again, field by field."""
    written = writer.to_musicxml(_scores(spark, d))
    return flat(corpus.parse_scores(written, "score_key", F.lit("musicxml"), "xml"))


_REFUSED = r"""
element_at(array(
  '4c', '**dynam\nf', '**kern\n*x\n4c', '**kern\n*+', '**kern\n17c', '**kern\n256c', '**kern\n000c', '**kern\nc', '**kern\n4', concat('**kern\n', repeat('*^\n', 8)), '**kern\n4.....c',
  concat('**kern\n*M17/', i % 9 + 1, '\n4c\n*-'), concat('**kern\n*k[', repeat('f#', cast(8 + i % 5 AS int)), ']\n4c\n*-'), concat('**kern', repeat('\t**kern', 32), '\n4c', repeat('\t4c', 32), '\n*-'), concat('**kern\n*M3/', 3, '\n4c\n*-'), '**kern\n4cccccccccc\n*-', ''
), cast(1 + i % 17 AS int))
"""


@_query("""
select p_partkey as i, ['no_exclusive_interpretation', 'unsupported_spines', 'unsupported', 'unsupported', 'unsupported_tuplet', 'unsupported_duration', 'unsupported_duration', 'missing_duration', 'missing_pitch', 'unsupported', 'unrepresentable_duration',
  'unsupported_time', 'key_out_of_range', 'too_many_parts', 'unsupported_time', 'unknown_token', 'no_exclusive_interpretation'][1 + p_partkey % 17] as code,
  case p_partkey % 17 when 1 then '**dynam' when 2 then 'spine_manipulation' when 3 then 'spine_manipulation' when 4 then '17' when 5 then '256' when 6 then 'maxima' when 7 then 'c' when 8 then '4' when 9 then 'too_many_voices 9' when 10 then '4.....'
  when 11 then '17:' || (p_partkey % 9 + 1) when 12 then cast(8 + p_partkey % 5 as varchar) when 13 then '33' when 14 then '3:3' when 15 then 'pitch:C:0:13' end as detail from part
""")
def refusals(spark, d):
    """N-refusals, R6, J1, A3 A4, 2.17: what the model can't hold, each with its code and detail, from parsing or from encoding."""
    cases = _numbers(spark, d).selectExpr("i", f"{_REFUSED} AS content")
    made = tokens.encode(corpus.parse_scores(cases, "i", F.lit("kern")))
    return made.select(F.col("score_key").cast("bigint").alias("i"), "error.code", "error.detail")


# Kern files as they came: two spines of plain notes.
_CELLS = """
k as (select file_id, string_split_regex(content, '\\r?\\n') as lines from raw_files where regexp_matches(content, '(^|\\n)\\*\\*kern')),
l as (select file_id, unnest(lines) as l, generate_subscripts(lines, 1) as r from k),
f as (select file_id, r, unnest(string_split(l, chr(9))) as f, generate_subscripts(string_split(l, chr(9)), 1) as s, len(string_split(l, chr(9))) as n from l where l <> '' and not starts_with(l, '*') and not starts_with(l, '!') and not starts_with(l, '=')),
notes as (
  select cast(file_id as bigint) as i, n - s as part_idx, row_number() over (partition by file_id, s order by r) - 1 as event_idx, upper(left(w, 1)) as step, case when contains(f, '#') then len(regexp_extract_all(f, '#')) else -len(regexp_extract_all(f, '-')) end as alter,
    case when w = lower(w) then 3 + length(w) else 4 - length(w) end as octave, case q when '1' then 'whole' when '2' then 'half' when '4' then 'quarter' when '8' then 'eighth' when '16' then '16th' when '32' then '32nd' end as dur_type, case q when '1' then 0 when '2' then 1 when '4' then 2 when '8' then 3 when '16' then 4 when '32' then 5 end as level
  from (select *, regexp_extract(f, '[a-gA-G]+') as w, regexp_extract(f, '[0-9]+') as q from f where f <> '.'))
"""


def _kern_files(spark: SparkSession, d: str) -> DataFrame:
    files = spark.read.parquet(f"{d}/raw_files.parquet").where(F.rlike("content", F.lit(r"(^|\n)\*\*kern")))
    return corpus.parse_scores(files, "file_id", F.lit("kern"))


@_query(f"with {_CELLS} select i, cast(part_idx as integer) as part_idx, cast(event_idx as integer) as event_idx, step, cast(alter as integer) as alter, cast(octave as integer) as octave, dur_type, 0 as dots, 1 as voice, 1 as number from notes")
def kern_notes(spark, d):
    """Every note of every kern file that was listed."""
    return flat(_kern_files(spark, d)).select("i", "part_idx", "event_idx", "step", "alter", "octave", "dur_type", "dots", "voice", "number")


_NOTE_XML = "'<note><pitch><step>' || step || '</step>' || case when alter <> 0 then '<alter>' || alter || '</alter>' else '' end || '<octave>' || octave || '</octave></pitch><duration>' || (92252160 // (2 ** level)::bigint) || '</duration><type>' || dur_type || '</type></note>' || chr(10)"


@_query(f"""
with {_CELLS}, body as (select i, part_idx, string_agg({_NOTE_XML}, '' order by event_idx) as x from notes group by i, part_idx),
doc as (select i, count(*) as n, string_agg('<score-part id="P' || (part_idx + 1) || '"><part-name>Voice</part-name></score-part>' || chr(10), '' order by part_idx) as listed, string_agg('<part id="P' || (part_idx + 1) || '">' || chr(10) || '<measure number="1">' || chr(10) || x || '</measure>' || chr(10) || '</part>' || chr(10), '' order by part_idx) as parts from body group by i)
select i, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 4.0 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd">' || chr(10) || '<score-partwise version="4.0">' || chr(10) || '<part-list>' || chr(10) || listed || '</part-list>' || chr(10) || parts || '</score-partwise>' || chr(10)) as digest from doc
""")
def xml_written(spark, d):
    """Every kern file as MusicXML, byte for byte."""
    return writer.to_musicxml(_kern_files(spark, d)).select(F.col("score_key").cast("bigint").alias("i"), F.md5("xml").alias("digest"))


# --- MusicXML -------------------------------------------------------------------------------------------------------


def _measure(text: str, divisions: int = 16) -> str:
    return f"concat('<score-partwise><work><work-title>T&amp;', i, '</work-title></work><part-list><score-part id=\"P1\"><part-name>Flute</part-name></score-part></part-list><part id=\"P1\"><measure number=\"', 1 + i % 5, '\"><attributes><divisions>{divisions}</divisions><key><fifths>', i % 8, '</fifths></key></attributes>', {text}, '</measure></part></score-partwise>')"


def _xml_note(step: str, length: int, kind: str | None = None, voice: int | None = None, more: str = "") -> str:
    inside = f"</step><alter>-1</alter><octave>', 2 + i % 4, '</octave></pitch><duration>{length}</duration>" + (f"<voice>{voice}</voice>" if voice else "") + (f"<type>{kind}</type>" if kind else "")
    return f"'<note>{more}<pitch><step>{step}{inside}</note>'"


_BACK, _FORWARD = "'<backup><duration>16</duration></backup>'", "'<forward><duration>{}</duration></forward>'"
_XML_CASES = [
    _measure(", ".join([_xml_note("C", 16, "quarter", 5), _BACK, _xml_note("E", 16, "quarter", 1), _xml_note("D", 16, "quarter", 5)])),
    _measure(", ".join([_xml_note("C", 16, "quarter"), _FORWARD.format(16), _xml_note("D", 16)])),
    _measure(", ".join([_xml_note("C", 12, "quarter"), _FORWARD.format(4), _xml_note("D", 12, "quarter")]), 12),
    _measure(", ".join([_xml_note("C", 24, more='<tie type="start"/>'), _xml_note("E", 24, "quarter", more="<chord/><dot/>"), "'<note><grace/><pitch><step>A</step><octave>4</octave></pitch></note><note><rest/><duration>8</duration></note>'"])),
    _measure(", ".join([_xml_note("C", 16, "quarter", 1), _xml_note("D", 16, "quarter", 1), _BACK, _xml_note("F", 16, "quarter", 2)])),
    _measure(", ".join([_xml_note("C", 32, "half"), _BACK, _xml_note("D", 16, "quarter")])), _measure(_xml_note("H", 16, "quarter")), _measure(_xml_note("C", 16, "1024th")), _measure("'<note><rest/></note>'"),
    _measure("'<note><unpitched/><duration>16</duration></note>'"), _measure(_xml_note("C", 5)), _measure("'<attributes><time><beats>4(2)</beats></time></attributes>'"), _measure("'<attributes><clef><sign>percussion</sign></clef></attributes>'"),
    _measure(", ".join([_xml_note("C", 17, "quarter"), _FORWARD.format(5), _xml_note("D", 17, "quarter")]), 17), "'<score-partwise>'",
]


def xml_cases(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).selectExpr("i", f"element_at(array({', '.join(_XML_CASES)}), cast(1 + i % {len(_XML_CASES)} AS int)) AS content")


def _told(scores: DataFrame) -> DataFrame:
    """Events, or the refusal's code."""
    rows = flat(scores).where("title = concat('T&', i)").select("i", "number", "key_sig", "instrument", "event_idx", "kind", "step", "alter", "octave", "dur_type", "dots", "tie", "chord", "voice", "actual", "normal", F.lit(None).cast("string").alias("code"))
    bad = scores.where("error is not null").select(F.col("score_key").cast("bigint").alias("i"), F.col("error.code").alias("code"))
    return rows.unionByName(bad, allowMissingColumns=True)


_XML_TOLD = """
e(c, event_idx, kind, step, dur_type, dots, tie, chord, voice, actual, normal) as (values
  (0, 0, 'note', 'C', 'quarter', 0, null, false, 1, null, null), (0, 1, 'note', 'D', 'quarter', 0, null, false, 1, null, null), (0, 2, 'note', 'E', 'quarter', 0, null, false, 2, null, null),
  (1, 0, 'note', 'C', 'quarter', 0, null, false, 1, null, null), (1, 1, 'rest', null, 'quarter', 0, null, false, 1, null, null), (1, 2, 'note', 'D', 'quarter', 0, null, false, 1, null, null),
  (2, 0, 'note', 'C', 'quarter', 0, null, false, 1, null, null), (2, 1, 'rest', null, 'eighth', 0, null, false, 1, 3, 2), (2, 2, 'note', 'D', 'quarter', 0, null, false, 1, null, null),
  (3, 0, 'note', 'C', 'quarter', 1, 'start', false, 1, null, null), (3, 1, 'note', 'E', 'quarter', 1, null, true, 1, null, null), (3, 2, 'rest', null, 'eighth', 0, null, false, 1, null, null),
  (4, 0, 'note', 'C', 'quarter', 0, null, false, 1, null, null), (4, 1, 'note', 'D', 'quarter', 0, null, false, 1, null, null), (4, 2, 'rest', null, 'quarter', 0, null, false, 2, null, null), (4, 3, 'note', 'F', 'quarter', 0, null, false, 2, null, null)),
told as (
  select p_partkey as i, cast(1 + p_partkey % 5 as integer) as number, cast(p_partkey % 8 as integer) as key_sig, 'flute' as instrument, cast(event_idx as integer) as event_idx, kind, step, cast(case when kind = 'note' then -1 end as integer) as alter, cast(case when kind = 'note' then 2 + p_partkey % 4 end as integer) as octave,
    dur_type, cast(dots as integer) as dots, tie, chord, cast(voice as integer) as voice, cast(actual as integer) as actual, cast(normal as integer) as normal, null::varchar as code from part join e on c = p_partkey % 15
  union all select p_partkey, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null,
    ['overlapping_voice', 'bad_step', 'unsupported_type', 'missing_duration_element', 'unpitched_note', 'unnotatable_duration', 'bad_time', 'unsupported_clef', 'unrepresentable_offset', 'other'][p_partkey % 15 - 4] from part where p_partkey % 15 >= 5)
"""


@_query(f"with {_XML_TOLD} select * from told")
def xml_fields(spark, d):
    """S7 M1..M19 A10 W5 W7 J9: what MusicXML documents say, field by field, and the codes of those the model can't hold."""
    return _told(corpus.parse_scores(xml_cases(spark, d), "i", F.lit("musicxml")))


def _zipped(content: Column, i: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        def one(text: str, n: int) -> bytes:
            if n % 7 == 6:
                return text.encode()  # no archive
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("META-INF/container.xml", "<container/>")
                if n % 7 != 5:
                    z.writestr("score.xml", text)
            return out.getvalue()

        return pd.Series([one(t, n) for t, n in zip(texts, numbers)])

    return pack(content, i)


@_query(f"with {_XML_TOLD} select * replace (case i % 7 when 5 then 'mxl_no_score_member' when 6 then 'mxl_unzip_failed' else code end as code) from told where i % 7 < 5 union all select p_partkey, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, case p_partkey % 7 when 5 then 'mxl_no_score_member' else 'mxl_unzip_failed' end from part where p_partkey % 7 >= 5")
def mxl_fields(spark, d):
    """The same documents in archives, some without a score in them, some no archives at all."""
    cases = xml_cases(spark, d).select("i", _zipped(F.col("content"), F.col("i")).alias("content"))
    return _told(corpus.parse_scores(cases, "i", F.lit("mxl")))


# --- transposition --------------------------------------------------------------------------------------------------


def _moved(letters: str, semitones: str, key: str) -> str:
    """Columns of an event moved by an interval, ``x`` being the rows with their ``d`` and ``c``."""
    return f"""
x as (select *, {letters} as d, {semitones} as c, list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], step) - 1 as s0 from ev),
y as (select *, s0 + d - 7 * floor((s0 + d) / 7.0)::integer as s1, floor((s0 + d) / 7.0)::integer as up from x),
moved as (select * replace (['C', 'D', 'E', 'F', 'G', 'A', 'B'][s1 + 1] as step, octave + up as octave, alter + [0, 2, 4, 5, 7, 9, 11][s0 + 1] + c - 12 * up - [0, 2, 4, 5, 7, 9, 11][s1 + 1] as alter, {key} as key_sig) from y)
"""


def _wrapped(k: str) -> str:
    return f"(case when {k} > 7 then {k} - 12 when {k} < -7 then {k} + 12 else {k} end)"


@_query(f"with {_EVENTS}, {_moved('2', '3', _wrapped('(key_sig - 3)'))} select {_WORDS}, {_PLACE}, {_SAME}, {_FREE}, {_NAMED} from moved")
def moved_scores(spark, d):
    """Every score a minor third up."""
    return flat(score.by_interval(_scores(spark, d), 2, 3))


@_query(f"with {_EVENTS}, {_moved('1', '2', _wrapped('(key_sig + 2)'))} select {_WORDS}, {_PLACE}, 'clarinet' as instrument, 'Clarinet' as name, -1 as diatonic, -2 as chromatic, {_NAMED} from moved")
def written_scores(spark, d):
    """Every part as a clarinet reads it."""
    return flat(score.to_written(_scores(spark, d), "clarinet"))


@_query(f"with {_EVENTS}, {_moved('0', '0', _wrapped('(' + _wrapped('(key_sig + 1)') + ' - 1)'))} select {_WORDS}, {_PLACE}, 'horn' as instrument, 'Horn' as name, {_FREE}, {_NAMED} from moved")
def concert_scores(spark, d):
    """Horn parts back to what sounds."""
    return flat(score.to_concert(score.to_written(_scores(spark, d), "horn"), "horn"))


# Tonics by their place among the fifths; to D major (2) the nearest way, down if both are as far.
_TO_D = f"""
tonics as (select k0, ['C', 'G', 'D', 'A', 'E', 'B', 'F'][1 + (k0 % 7 + 7) % 7] as t from (select range - 7 as k0 from range(15))),
up as (select k0, ((2 - k0) * 7 % 12 + 12) % 12 as semitones, (1 - (list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], t) - 1) + 7) % 7 as letters from tonics),
ways as (select k0, case when semitones = 0 then 0 when semitones < 6 then letters else letters - 7 end as d, case when semitones < 6 then semitones else semitones - 12 end as c from up)
"""


@_query(f"with {_EVENTS}, {_TO_D}, {_moved('(select w.d from ways w where w.k0 = (select p.k from p where p.i = ev.i))', '(select w.c from ways w where w.k0 = (select p.k from p where p.i = ev.i))', 'case when key_sig is not null then 2 end')} select {_WORDS}, {_PLACE}, {_SAME}, {_FREE}, {_NAMED} from moved")
def keyed_scores(spark, d):
    """Every score moved from its own key to D major, the nearest way."""
    return flat(score.to_key(_scores(spark, d), 2))


@_query(f"""with {_EVENTS}, {_moved('case part_idx when 0 then 1 else 4 end', 'case part_idx when 0 then 2 else 7 end', _wrapped('(key_sig + case part_idx when 0 then 2 else 1 end)'))}
select {_WORDS}, {_PLACE}, case part_idx when 0 then 'clarinet' else 'horn' end as instrument, case part_idx when 0 then 'Clarinet' else 'Horn' end as name, case part_idx when 0 then -1 else -4 end as diatonic, case part_idx when 0 then -2 else -7 end as chromatic, {_NAMED} from moved""")
def duet_scores(spark, d):
    """The outer parts for clarinet and horn."""
    return flat(score.duet(_scores(spark, d), "clarinet", "horn")[0])


_MIDI = "12 * (octave + 1) + [0, 2, 4, 5, 7, 9, 11][list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], step)] + alter"


@_query(f"with {_EVENTS}, n as (select *, {_MIDI} as midi from ev where kind = 'note') select i, cast(part_idx as integer) as part_idx, cast(number as integer) as number, cast(event_idx as integer) as event_idx, cast(midi as integer) as midi from n where case part_idx when 0 then midi < 60 or midi > 98 else midi < 40 or midi > 77 end")
def duet_problems(spark, d):
    """The notes that a flute and a trombone can't play of the outer parts."""
    found = score.duet(_scores(spark, d), "flute", "trombone")[1]
    return found.select(F.col("score_key").cast("bigint").alias("i"), "part_idx", "number", "event_idx", "midi")


# --- tokens ---------------------------------------------------------------------------------------------------------


def _encoded_sql(vocabulary: str) -> str:
    return f"""
with {vocabulary}, {_EVENTS},
t as (
  select i, 0 as o, 'bos' as token from p union all select i, 1, 'instrument:violin' from p union all select i, 2, 'instrument:bass' from p union all select i, 999999, 'eos' from p
  union all select i, m.range * 10000, 'measure' from p, range(1, 3) m
  union all select i, m.range * 10000 + q.range * 4000 + 1, 'part:' || q.range from p, range(1, 3) m, range(2) q
  union all select i, 10000 + q.range * 4000 + 2, 'key:' || k from p, range(2) q
  union all select i, 14003, 'time:' || (1 + i % 12) || ':' || [1, 2, 4, 8, 16][1 + i % 5] from p
  union all select i, 10004, 'clef:treble' from p union all select i, 14004, 'clef:bass' from p
  union all select i, number * 10000 + part_idx * 4000 + 100 + event_idx * 10 + z.j, z.token from ev, unnest([
    {{'j': 0, 'token': case when voice = 2 then 'voice:2' end}}, {{'j': 1, 'token': case when chord then 'chord' end}}, {{'j': 2, 'token': case kind when 'rest' then 'rest' else 'pitch:' || step || ':' || alter || ':' || octave end}},
    {{'j': 3, 'token': 'dur:' || dur_type || ':' || dots}}, {{'j': 4, 'token': 'tuplet:' || actual || ':' || normal}}, {{'j': 5, 'token': case tie when 'stop' then 'tie_stop' end}}, {{'j': 6, 'token': case tie when 'start' then 'tie_start' end}}]) as u(z) where z.token is not null)
select i, string_agg(token_id, ' ' order by o) as ids from t left join vocab using (token) group by i
"""


def encoded_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every score, in order."""
    made = tokens.encode(_scores(spark, d))
    return made.select(F.col("score_key").cast("bigint").alias("i"), F.array_join("tokens", " ").alias("ids"))


@_query(f"with {_EVENTS} select {_WORDS.replace(', clef', '')}, {', '.join(x for x in _PLACE.split(', ') if not any(y in x for y in ('key_sig', 'beats', 'beat_type')))}, cast(number - 1 as integer) as measure_idx from ev")
def decoded_scores(spark, d):
    """Encoded, packed as bytes, unpacked and decoded again, field by field."""
    made = tokens.encode(_scores(spark, d)).select("score_key", "tokens")
    back = corpus.unpacked(corpus.packed_bytes(made))
    return tokens.decode(back, "score_key")[2].withColumn("i", F.col("score_key").cast("bigint")).drop("score_key")


@_query(f"with {_EVENTS} select distinct i, cast(part_idx as integer) as part_idx, cast(number as integer) as number, cast(number - 1 as integer) as measure_idx, cast(key_sig as integer) as key_sig, cast(beats as integer) as beats, cast(beat_type as integer) as beat_type, clef, {_SAME} from ev")
def decoded_measures(spark, d):
    """What measures and parts state, decoded."""
    parts, measures, _ = tokens.decode(tokens.encode(_scores(spark, d)).select("score_key", "tokens"), "score_key")
    return measures.join(parts, ["score_key", "part_idx"]).withColumn("i", F.col("score_key").cast("bigint")).drop("score_key")


# --- a corpus -------------------------------------------------------------------------------------------------------


@_query(f"""
with {_CELLS}, n as (select cast(i as varchar) as score_key, 4 + 2 * count(distinct part_idx) - 1 + 2 * count(*) as tokens from notes group by i)
select score_key, score_key as key, cast(tokens as bigint) as tokens, cast(2 * coalesce(sum(tokens) over (order by score_key rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset, cast(tokens as bigint) as stored, 1 as version, 666 as vocab_size, 'kern' as format from n
""")
def corpus_index(spark, d):
    """A corpus of all kern files, written and loaded: index, offsets in the order of keys, shards, metadata."""
    out = new_path(spark, "corpus")
    corpus.write_corpus(_kern_files(spark, d), out, "kern")
    shards = spark.read.parquet(f"{out}/tokens").select("score_key", F.size("tokens").cast("bigint").alias("stored"))
    return corpus.load_index(spark, out).join(shards, "score_key").crossJoin(spark.read.parquet(f"{out}/meta"))  # one row
