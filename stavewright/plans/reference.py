"""Queries that run the engine's operators over the test tables, each with SQL that restates it for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavewright.functions import duration, pitch
from stavewright.functions.fixed import INSTRUMENTS, INTERVALS, RATIOS, TRANSPOSITIONS, TYPES
from stavewright.functions.names import base_name, normalise
from stavewright.operators import layout, sampling, score, stats, tokens
from stavewright.plans import scores
from stavewright.sources import corpus, dimensions
from stavewright.storage import new_path
from stavewright.streaming import ingest
from stavewright.cli import by_family, instrument_table, matches, transposing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows: list[tuple], columns: str) -> str:
    """Rows of fixed values as a SQL relation."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as v({columns})"


# --- statistics -----------------------------------------------------------------------------------------------------


@_query("""
with s as (select lang, n_chars as v, row_number() over (partition by lang order by n_chars) - 1 as r, count(*) over (partition by lang) as n from documents where n_chars is not null)
select lang, count(*) as files, cast(sum(v) as bigint) as total, min(v) as least, max(v) as most,
  max(case when r = least(cast(round(cast(0.5 as double) * n) as bigint), n - 1) then v end) as p50, max(case when r = least(cast(round(cast(0.9 as double) * n) as bigint), n - 1) then v end) as p90
from s group by lang
""")
def length_stats(spark, d):
    """Counts and nearest-rank percentiles of document lengths by language."""
    docs = _t(spark, d, "documents").where("n_chars is not null")
    ps = stats.percentiles(docs, ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9}).withColumnRenamed("lang", "_l")
    base = docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return base.join(ps, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


@_query("""
with ok as (select source, len(tokens) as v from tokens_bin where len(tokens) > 0), bad as (select source from tokens_bin where tokens is null or len(tokens) = 0),
r as (select source, v, row_number() over (partition by source order by v) - 1 as r, count(*) over (partition by source) as n from ok),
g as (select source, count(*) as files_ok, cast(sum(v) as bigint) as total_tokens, min(v) as min_tokens, max(v) as max_tokens,
  max(case when r = least(cast(round(cast(0.5 as double) * n) as bigint), n - 1) then v end) as p50, max(case when r = least(cast(round(cast(0.9 as double) * n) as bigint), n - 1) then v end) as p90 from r group by source),
b as (select source, count(*) as files_failed from bad group by source)
select source, coalesce(files_ok, 0) as files_ok, coalesce(total_tokens, 0) as total_tokens, min_tokens, max_tokens, coalesce(files_failed, 0) as files_failed, p50, p90 from g full join b using (source)
""")
def corpus_stats(spark, d):
    """What a corpus reports of itself, by source."""
    seqs = _t(spark, d, "tokens_bin").select("source", F.coalesce(F.when(F.col("tokens").isNotNull(), F.size("tokens")), F.lit(0)).cast("bigint").alias("tokens"))
    return stats.corpus_stats(seqs.where("tokens > 0"), seqs.where("tokens = 0"), ["source"])


def _failures(df: DataFrame) -> DataFrame:
    return df.withColumn("code", F.when(F.col("content").isNull() | (F.col("content") == ""), "empty").when(~F.startswith("content", F.lit("**")), "no_exclusive_interpretation"))


@_query("""
with c as (select case when content is null or content = '' then 'empty' when not starts_with(content, '**') then 'no_exclusive_interpretation' else 'other' end as code from raw_files)
select code, count(*) as n from c group by code
""")
def failure_histogram(spark, d):
    """A3 O3: refusals by code."""
    return stats.failure_histogram(_failures(_t(spark, d, "raw_files")), F.col("code"))


@_query("""
with n as (select s.source, count(*) as total, count(t.seq_id) as ok from scores s left join (select seq_id from tokens_bin where len(tokens) > 0) t on t.seq_id = s.score_id group by s.source)
select source, total, ok, round(100.0::double * ok / total, 1) as pct from n
""")
def coverage_pct(spark, d):
    """A5: the share of scores that were encoded."""
    ok = _t(spark, d, "tokens_bin").where("size(tokens) > 0").select(F.col("seq_id").alias("score_id"), F.lit(1).alias("hit"))
    n = _t(spark, d, "scores").join(ok, "score_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("hit").alias("ok"))
    return n.withColumn("pct", stats.coverage(F.col("ok"), F.col("total")))


@_query("""
select vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)))) + list_max(embedding)::double - embedding[label + 1]::double, 6) as loss from embeddings
""")
def cross_entropy(spark, d):
    """L4: the loss of each row, its embedding read as logits and its label as the target."""
    return _t(spark, d, "embeddings").select("vec_id", F.round(stats.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


@_query("""
with l as (select label, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)))) + list_max(embedding)::double - embedding[label + 1]::double, 6) as loss from embeddings)
select label, count(*) as n, round(avg(loss), 4) as mean_loss, round(1000.0 * count(*) / (1 + label), 4) as per_second from l group by label
""")
def mean_losses(spark, d):
    """The mean loss by label, and rows a second if the label were the seconds spent."""
    losses = cross_entropy(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return losses.groupBy("label").agg(F.count("*").alias("n"), F.round(stats.mean_loss(F.col("loss")), 4).alias("mean_loss"), F.round(stats.throughput(F.count("*") * 1000, F.first("label") + 1), 4).alias("per_second"))


@_query("""
with p as (select tokens[i] as token, tokens[i + 1] as next from tokens_bin, unnest(generate_series(1, len(tokens) - 1)) as g(i) where len(tokens) > 1), c as (select token, next, count(*) as n from p group by all)
select token, next, n, n / sum(n) over (partition by token) as p from c
""")
def bigram_table(spark, d):
    """L1: the table a model of the current token alone could learn."""
    return stats.bigrams(_t(spark, d, "tokens_bin"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@_query("""
select entry_id, source, shard, cast(2 * coalesce(sum(coalesce(tokens, 0)) over (partition by source, shard order by entry_id rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from entries
""")
def shard_offsets(spark, d):
    """Where each entry begins in its shard."""
    return sampling.byte_offsets(_t(spark, d, "entries").select("entry_id", "source", "shard", "tokens"), ["source", "shard"], ["entry_id"]).drop("tokens")


@_query("""
select 'mxl/' || key as path from raw_files where 'mxl/' || key in (select path from raw_files)
""")
def subset_listing(spark, d):
    """A list of json names mapped to the files that exist, mentions kept."""
    files = _t(spark, d, "raw_files")
    listed = files.select(F.concat(F.lit("./data/"), F.regexp_replace("key", r"\.mxl$", ".json")).alias("value")).where("value like '%.json'")
    other = files.where("key not like '%.mxl'").select(F.concat(F.lit("mxl/"), "key").alias("value"))
    return corpus.subset(listed.unionByName(other), files.select("path"))


@_query("select score_id from scores where score_id not in (select seq_id from tokens_bin)")
def pending_scores(spark, d):
    """Scores nothing was encoded for."""
    return corpus.pending(_t(spark, d, "scores").select("score_id"), _t(spark, d, "tokens_bin").select(F.col("seq_id").alias("score_id")), "score_id")


@_query("""
select seq_id, md5(string_agg(lpad(lower(to_hex(t % 256)), 2, '0') || lpad(lower(to_hex(t // 256)), 2, '0'), '' order by i)) as digest, cast(2 * count(*) as bigint) as n_bytes
from (select seq_id, unnest(tokens) as t, unnest(generate_series(1, len(tokens))) as i from tokens_bin where len(tokens) > 0) group by seq_id
""")
def packed_shards(spark, d):
    """The bytes of each sequence in a shard."""
    packed = _t(spark, d, "tokens_bin").where("size(tokens) > 0").select("seq_id", sampling.pack_u16(F.col("tokens")).alias("b"))
    return packed.select("seq_id", F.md5(F.lower(F.hex("b"))).alias("digest"), F.length("b").cast("bigint").alias("n_bytes"))


@_query("""
with k as (select file_id, string_split_regex(content, '\\n') as lines from raw_files where starts_with(content, '**kern')),
f as (select file_id, unnest(string_split(l, chr(9))) as f from (select file_id, unnest(lines) as l from k) where l <> '' and not starts_with(l, '*') and not starts_with(l, '=') and not starts_with(l, '!'))
select file_id, count(*) as n_events, cast(coalesce(sum(length(regexp_replace(regexp_extract(f, '[a-gA-G]+'), '[^a-g]', '', 'g')) > 0), 0) as bigint) as n_low from f where f <> '.' group by file_id
""")
def kern_events(spark, d):
    """Kern files parsed into events; how many each has, and how many of them from middle C up."""
    files = _t(spark, d, "raw_files").where(F.startswith("content", F.lit("**kern")))
    parsed = corpus.parse_scores(files, "file_id", F.lit("kern"))
    events = score.events_of(parsed)
    return events.groupBy(F.col("score_key").cast("bigint").alias("file_id")).agg(F.count("*").alias("n_events"), F.count_if(F.col("octave") >= 4).alias("n_low"))


@_query(f"""
with {scores._CELLS}, n as (select i, 4 + 2 * count(distinct part_idx) - 1 + 2 * count(*) as tokens from notes group by i),
files as (select cast(file_id as varchar) as score_key, file_id, content, (select max(format) from sources s where s.source = r.source) as format from raw_files r),
told as (
  select score_key, n.tokens, case when content is null then 'empty' when format is null or format not in ('kern', 'musicxml', 'mxl') then 'unknown_format' when format = 'kern' then case when n.tokens is null then 'no_exclusive_interpretation' end
    when starts_with(content, '<') then 'crash' else 'other' end as code from files left join n on n.i = file_id)
select score_key, cast(case when code is null then tokens end as bigint) as tokens, cast(case when code is null then 2 * coalesce(sum(case when code is null then tokens end) over (order by score_key rows between unbounded preceding and 1 preceding), 0) end as bigint) as byte_offset, code from told
""")
def kern_ingest(spark, d):
    """Every listed file parsed by its source's format and encoded; index rows and typed refusals.

    A source that isn't in the catalogue has files of an unknown format. Content is text,
    so what it holds of an mxl file is the MusicXML inside.
    """
    formats = _t(spark, d, "sources").groupBy("source").agg(F.max("format").alias("format"))
    files = _t(spark, d, "raw_files").join(formats, "source", "left")
    kind = F.when(F.col("format") == "mxl", "musicxml").otherwise(F.col("format"))
    _, entries, errors = corpus.ingest(corpus.parse_scores(files, "file_id", kind))
    return entries.select("score_key", "tokens", "byte_offset", F.lit(None).cast("string").alias("code")).unionByName(errors.select("score_key", F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("byte_offset"), "code"))


# --- order within measures ------------------------------------------------------------------------------------------

_GROUPS = """
with f as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id))
"""


@_query(_GROUPS + "select event_id, cast(sum(b) over (partition by user_id order by ts, event_id) - 1 as bigint) as group_no from f")
def voice_groups(spark, d):
    """Runs of one event type of each user."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return layout.voice_groups(e, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "group_no")


@_query("""
with f as (select event_id, user_id, event_type, min(event_id) over (partition by user_id, event_type) as m from events)
select event_id, cast(dense_rank() over (partition by user_id order by m) as integer) as by_appearance, cast(dense_rank() over (partition by user_id order by event_type) as integer) as ascending from f
""")
def voice_renumbering(spark, d):
    """Dense voice numbers, by appearance and upward."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    e = layout.renumber_by_appearance(e, ["user_id"], "event_id", "event_type").withColumnRenamed("dense_voice", "by_appearance")
    return layout.renumber_ascending(e, ["user_id"], "event_type").select("event_id", "by_appearance", F.col("dense_voice").alias("ascending"))


_KINDS = "case event_type when 'error' then 'backup' when 'signup' then 'chord' when 'purchase' then 'forward' else 'note' end"


@_query(f"""
with k as (select event_id, user_id, {_KINDS} as kind, cast(floor(coalesce(value, 0)) as bigint) as n from events),
p as (select *, coalesce(sum(case kind when 'backup' then -n when 'chord' then 0 else n end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as position from k),
s as (select *, case when kind = 'chord' then coalesce(last_value(case when kind = 'note' then position end ignore nulls) over (partition by user_id order by event_id), 0) else position end as starts_at from p),
e as (select *, last_value(case when kind = 'note' then starts_at + n end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as ended from s where kind in ('note', 'chord'))
select event_id, cast(starts_at as bigint) as starts_at, cast(case when kind = 'chord' then 0 else starts_at - coalesce(ended, 0) end as bigint) as gap from e
""")
def cursor_layout(spark, d):
    """Positions from a cursor that backs up, and the gaps and overlaps between what it places."""
    e = _t(spark, d, "events").select("event_id", "user_id", F.expr(_KINDS).alias("kind"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("n"))
    placed = layout.cursor(e, ["user_id"], ["event_id"], "kind", "n").where("kind in ('note', 'chord')")
    return layout.gaps(placed, ["user_id"], ["event_id"], "starts_at", "n", F.col("kind") == "chord").select("event_id", "starts_at", "gap")


@_query("""
with recursive l as (
  select l_orderkey, l_quantity > 10 as t, case when l_quantity % 2 = 0 then 1 else 2 end as m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity > 10, case when l_quantity % 2 = 0 then 1 else 2 end) as rn from lineitem),
-- Sums count two thirds of an eighth; those that a written value has: 3, 9, 21, 45 and 93, doubled at will.
plain as (select n * (2 ** k)::bigint as v from (values (3), (9), (21), (45), (93)) as b(n), range(8) as r(k)),
f as (
  select l_orderkey, rn, t, 0::bigint as last, 0::bigint as total, 0::bigint as id from (select l_orderkey, 0::bigint as rn, false as t from l group by l_orderkey)
  union all
  select f.l_orderkey, l.rn, l.t, greatest(f.last, x.id), case when l.t and f.s + l.m not in (select v from plain) then f.s + l.m else 0 end, x.id
  from (select *, total as s, total > 0 as goes from f) f join l on l.l_orderkey = f.l_orderkey and l.rn = f.rn + 1, lateral (select case when not l.t then 0 when f.goes then f.last else f.last + 1 end as id) x),
n as (select *, lag(id) over w as before, lead(id) over w as after from (select * from f where rn > 0) window w as (partition by l_orderkey order by rn))
select l_orderkey, string_agg(case when id = 0 then '-' when id is distinct from before and id is distinct from after then 'both' when id is distinct from before then 'start' when id is distinct from after then 'stop' else '-' end, ' ' order by rn) as marks from n group by l_orderkey
""")
def tuplet_brackets(spark, d):
    """Bracket marks over each order's lines, the quantity read as a ratio."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 10, F.lit("3:2")).alias("ratio"), F.when(F.col("l_quantity") % 2 == 0, F.lit(7687680)).otherwise(F.lit(15375360)).cast("bigint").alias("sounding")).alias("e"))
    runs = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["ratio"].alias("ratio"), e["sounding"].alias("sounding"))).alias("events"))
    return runs.select("l_orderkey", F.array_join(layout.tuplet_marks(F.col("events")), " ", "-").alias("marks"))


# --- pitch, keys, durations -----------------------------------------------------------------------------------------

_PITCH = """
with p as (select p_partkey, 1 + p_partkey % 7 as s, p_size % 5 - 2 as alter, p_partkey % 9 as octave, p_size % 31 - 15 as d, p_size % 53 - 26 as c from part),
n as (select *, [0, 2, 4, 5, 7, 9, 11] as nat, ['C', 'D', 'E', 'F', 'G', 'A', 'B'] as steps, s - 1 + d as i, cast(floor((s - 1 + d) / 7.0) as integer) as up from p),
t as (select *, 12 * (octave + 1) + nat[s] + alter as midi, i - 7 * up + 1 as s2, octave + up as octave2 from n)
"""


@_query(_PITCH + """
select p_partkey, cast(midi as integer) as midi, cast([0, 2, 4, -1, 1, 3, 5][s] + 7 * alter as integer) as place, steps[s2] as step2, cast(midi + c - (12 * (octave2 + 1) + nat[s2]) as integer) as alter2, cast(octave2 as integer) as octave2 from t
""")
def transpose_spelled(spark, d):
    """F1..F5: spelled pitches, their MIDI number and place among the fifths, moved by an interval."""
    p = _t(spark, d, "part").select("p_partkey", pitch.step_at(F.col("p_partkey").cast("int")).alias("step"), (F.col("p_size") % 5 - 2).alias("alter"), (F.col("p_partkey") % 9).cast("int").alias("octave"), (F.col("p_size") % 31 - 15).alias("d"), (F.col("p_size") % 53 - 26).alias("c"))
    s, a, o = (F.col(x) for x in ("step", "alter", "octave"))
    s2, a2, o2 = pitch.transpose(s, a, o, F.col("d"), F.col("c"))
    return p.select("p_partkey", pitch.midi(s, a, o).alias("midi"), pitch.fifths(s, a).alias("place"), s2.alias("step2"), a2.alias("alter2"), o2.alias("octave2"))


@_query("""
with k as (select a.range - 7 as k0, b.range - 7 as k1 from range(15) a, range(15) b),
t as (select *, ['C', 'G', 'D', 'A', 'E', 'B', 'F'] as circle from k),
p as (select k0, k1, list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], circle[1 + ((k0 % 7) + 7) % 7]) - 1 as i0, list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], circle[1 + ((k1 % 7) + 7) % 7]) - 1 as i1 from t),
m as (select *, ((k0 * 7 % 12) + 12) % 12 as m0 from p),
q as (select *, i1 - i0 as d,
  ([0, 2, 4, 5, 7, 9, 11][i1 + 1] + cast(floor((k1 - [0, 2, 4, -1, 1, 3, 5][i1 + 1]) / 7.0) as integer)) - ([0, 2, 4, 5, 7, 9, 11][i0 + 1] + cast(floor((k0 - [0, 2, 4, -1, 1, 3, 5][i0 + 1]) / 7.0) as integer)) as c from m),
u as (select *, case when c < 0 then c + 12 else c end as up, case when c > 0 then c - 12 else c end as dn from q)
select cast(k0 as integer) as k0, cast(k1 as integer) as k1,
  cast(case when abs(up) < abs(dn) then d + case when c < 0 then 7 else 0 end else d - case when c > 0 then 7 else 0 end end as integer) as letters,
  cast(case when abs(up) < abs(dn) then up else dn end as integer) as semitones, cast(k1 as integer) as arrives from u
""")
def key_intervals(spark, d):
    """From every key signature to every other, and where the interval found leads."""
    k = spark.range(15).select((F.col("id") - 7).cast("int").alias("k0")).withColumn("k1", F.explode(F.sequence(F.lit(-7), F.lit(7))))
    l, s = pitch.key_interval(F.col("k0"), F.col("k1"))
    return k.select("k0", "k1", l.alias("letters"), s.alias("semitones"), pitch.transpose_key(F.col("k0"), l, s).alias("arrives"))


_DUR = _values([(t, i) for i, t in enumerate(TYPES)], "t, i")
_RATIO_ROWS = _values([(None, None), *RATIOS], "a, n")
_BASE_SQL = "[184504320, 92252160, 46126080, 23063040, 11531520, 5765760, 2882880, 1441440, 720720, 360360, 369008640]"


@_query(f"""
with x as (select t, dots, a, n, {_BASE_SQL}[i + 1]::hugeint * (2 ** (dots + 1) - 1)::hugeint * coalesce(n, 1) as num, (2 ** dots)::hugeint * coalesce(a, 1) as den
  from (select t, i from {_DUR}) , (select unnest(range(5)) as dots), (select a, n from {_RATIO_ROWS}))
select t as dur_type, cast(dots as integer) as dots, cast(a as integer) as actual, cast(n as integer) as normal, case when num % den = 0 then cast(num // den as bigint) end as divisions from x
""")
def duration_divisions(spark, d):
    """The length of every duration in every tuplet, NULL where it isn't whole."""
    types = spark.createDataFrame([(t,) for t in TYPES], "dur_type string").withColumn("dots", F.explode(F.sequence(F.lit(0), F.lit(4))))
    ratios = spark.createDataFrame([(None, None), *RATIOS], "actual int, normal int")
    every = types.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("actual"), F.lit(n).cast("int").alias("normal")) for a, n in [(None, None), *RATIOS]]))).select("dur_type", "dots", "_r.*")
    return every.withColumn("divisions", duration.divisions(F.col("dur_type"), F.col("dots"), F.col("actual"), F.col("normal")))


@_query(f"""
with x as (select t, dots, {_BASE_SQL}[i + 1]::hugeint * (2 ** (dots + 1) - 1)::hugeint as num, (2 ** dots)::hugeint as den from (select t, i from {_DUR}), (select unnest(range(5)) as dots)),
v as (select t, dots, cast(num // den as bigint) as n from x where num % den = 0),
l as (select l_orderkey, l_partkey, l_suppkey, cast(l_quantity as bigint) * 360360 as span from lineitem)
select l_orderkey, l_partkey, l_suppkey, span, t as dur_type, cast(dots as integer) as dots from l left join v on n = span
""")
def plain_durations(spark, d):
    """spans read back as written durations."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("bigint") * 360360).alias("span"))
    found = duration.from_divisions(F.col("span"))
    return l.withColumn("f", found).select("l_orderkey", "l_partkey", "l_suppkey", "span", F.col("f.type").alias("dur_type"), "f.dots")


@_query("""
with recursive f as (select p_partkey, p_size as r, p_size as odd from part union all select p_partkey, r, odd // 2 from f where odd % 2 = 0 and odd > 0),
o as (select p_partkey, min(odd) as odd, any_value(r) as r from f group by p_partkey)
select p_partkey, cast(case when odd = 1 then r when odd in (3, 5, 7, 9, 11, 13, 15) then r * (case when odd > 8 then 8 when odd > 4 then 4 else 2 end) // odd end as integer) as base,
  cast(case when odd in (3, 5, 7, 9, 11, 13, 15) then odd end as integer) as actual, cast(case when odd in (3, 5, 7, 9, 11, 13, 15) then case when odd > 8 then 8 when odd > 4 then 4 else 2 end end as integer) as normal from o
""")
def recip_factors(spark, d):
    """Reciprocals split into a power of two and a tuplet."""
    return _t(spark, d, "part").select("p_partkey", duration.recip(F.col("p_size")).alias("r")).select("p_partkey", "r.base", "r.actual", "r.normal")


@_query("""
with recursive units(i, u, t) as (values (1, 1024, 'long'), (2, 512, 'breve'), (3, 256, 'whole'), (4, 128, 'half'), (5, 64, 'quarter'), (6, 32, 'eighth'), (7, 16, '16th'), (8, 8, '32nd'), (9, 4, '64th'), (10, 2, '128th'), (11, 1, '256th')),
g as (select p_partkey, p_partkey * 7 % 3000 as lft, 0 as i, 0 as n, '' as t from part union all select p_partkey, lft % u, units.i, lft // u, units.t from g join units on units.i = g.i + 1)
select p_partkey, cast(sum(n) as integer) as n_rests, coalesce(string_agg(repeat(t || ' ', n::integer), '' order by i), '') as rests from g group by p_partkey
""")
def greedy_rests(spark, d):
    """F16: spans of the smallest rest filled with rests, longest first."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 3000 * 360360).alias("span"))
    rests = duration.decompose_rests(F.col("span"))
    return p.select("p_partkey", F.size(rests).alias("n_rests"), F.array_join(F.transform(rests, lambda r: F.concat(r["type"], F.lit(" "))), "").alias("rests"))


@_query("""
with recursive units(i, u, t) as (values (1, 1024, 'long'), (2, 512, 'breve'), (3, 256, 'whole'), (4, 128, 'half'), (5, 64, 'quarter'), (6, 32, 'eighth'), (7, 16, '16th'), (8, 8, '32nd'), (9, 4, '64th'), (10, 2, '128th'), (11, 1, '256th')),
p as (select p_partkey, p_partkey * 7 % 3000 as n from part),
-- In thirds of a 256th: plain rests if they make it up, else triplets alone, else as few triplets as leave plain rests.
s as (
  select p_partkey, 1 as part, n // 3 as m, '' as ratio from p where n % 3 = 0
  union all select p_partkey, 1, n // 2, ' 3:2' from p where n % 3 <> 0 and n % 2 = 0
  union all select p_partkey, 1, (n - 2) // 3, '' from p where n % 3 = 2 and n % 2 = 1 union all select p_partkey, 2, 1, ' 3:2' from p where n % 3 = 2 and n % 2 = 1
  union all select p_partkey, 1, (n - 4) // 3, '' from p where n % 3 = 1 and n % 2 = 1 and n > 1 union all select p_partkey, 2, 2, ' 3:2' from p where n % 3 = 1 and n % 2 = 1 and n > 1),
g as (select p_partkey, part, ratio, m as lft, 0 as i, 0 as n, '' as t from s union all select p_partkey, part, ratio, lft % u, units.i, lft // u, units.t from g join units on units.i = g.i + 1),
r as (select p_partkey, string_agg(repeat(t || ratio || ', ', n::integer), '' order by part, i) as rests from g group by p_partkey)
select p_partkey, p_partkey * 7 % 3000 * 120120 as span, rests from p left join r using (p_partkey)
""")
def tuplet_rests(spark, d):
    """spans no plain rests make up, filled with tuplet rests or refused (NULL)."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 3000 * 120120).alias("span"))
    written = F.transform(duration.decompose_rests(F.col("span")), lambda r: F.concat(r["type"], F.when(r["actual"].isNotNull(), F.concat(F.lit(" "), r["actual"], F.lit(":"), r["normal"])).otherwise(F.lit("")), F.lit(", ")))
    return p.withColumn("rests", F.array_join(written, ""))


# --- instruments ----------------------------------------------------------------------------------------------------

_ROSTER = _values([(i, x[0], x[1], x[2], x[4], x[5], x[6], *(TRANSPOSITIONS[x[6]] if x[6] else (None, None)), "|".join(x[7])) for i, x in enumerate(INSTRUMENTS)], "ord, instrument, name, family, low, high, transposition, d, c, aliases")
_NORM = "regexp_replace(replace(replace(lower({}), '♭', 'b'), '♯', '#'), '[^a-z0-9#]', '', 'g')"


@_query(f"""
with names as (select ord, instrument, unnest(list_prepend(name, string_split(aliases, '|'))) as n from {_ROSTER}),
keyed as (select {_NORM.format('n')} as k, min_by(instrument, ord) as found from names where n <> '' group by 1)
select part_id, coalesce(found, 'voice') as instrument from score_parts left join keyed on k = {_NORM.format('score_parts.name')}
""")
def instrument_lookup(spark, d):
    """Names of parts resolved through the roster, else voice."""
    parts = _t(spark, d, "score_parts").select("part_id", normalise(F.col("name")).alias("name_key"))
    return parts.join(F.broadcast(dimensions.instrument_names(spark)), "name_key", "left").select("part_id", F.coalesce("instrument", F.lit("voice")).alias("instrument"))


@_query(f"""
select l_orderkey, l_partkey, l_suppkey, instrument, cast(l_quantity + 40 as integer) as midi from lineitem join {_ROSTER} on ord = l_partkey % 98 where l_quantity + 40 < low or l_quantity + 40 > high
""")
def range_check(spark, d):
    """Notes outside the range of their instrument."""
    roster = dimensions.instruments(spark).select("ord", "instrument", "low_midi", "high_midi")
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_quantity") + 40).cast("int").alias("midi"), (F.col("l_partkey") % 98).cast("int").alias("ord"))
    joined = l.join(F.broadcast(roster), "ord")
    return joined.where(~score.in_range(F.col("midi"), F.col("low_midi"), F.col("high_midi"))).select("l_orderkey", "l_partkey", "l_suppkey", "instrument", "midi")


@_query(f"""
select instrument, family, cast(low as integer) as low_midi, cast(high as integer) as high_midi from {_ROSTER}
where transposition is not null and (contains(lower(instrument), 'bass') or contains(lower(name), 'bass') or contains(lower(aliases), 'bass'))
""")
def instrument_search(spark, d):
    """Transposing instruments with "bass" in id, name or an alias."""
    return transposing(dimensions.instruments(spark)).where(matches("Bass")).select("instrument", "family", "low_midi", "high_midi")


# How each transposition reads, and the key it writes C major in.
_READS = [
    ("major_ninth_down", "M2 + 1 octave down", "D major"), ("major_second_down", "M2 down", "D major"), ("major_second_up", "M2 up", "Bb major"), ("major_sixth_down", "M6 down", "A major"), ("major_sixth_up", "M6 up", "Eb major"),
    ("major_thirteenth_down", "M6 + 1 octave down", "A major"), ("minor_seventh_down", "m7 down", "Bb major"), ("minor_seventh_up", "m7 up", "D major"), ("minor_sixth_down", "m6 down", "Ab major"), ("minor_sixth_up", "m6 up", "E major"),
    ("minor_third_down", "m3 down", "Eb major"), ("minor_third_up", "m3 up", "A major"), ("octave_down", "1 octave down", "C major"), ("octave_perfect_fourth_down", "P4 + 1 octave down", "F major"), ("octave_up", "1 octave up", "C major"),
    ("perfect_fifth_down", "P5 down", "G major"), ("perfect_fifth_up", "P5 up", "F major"), ("perfect_fourth_down", "P4 down", "F major"), ("perfect_fourth_up", "P4 up", "G major"), ("two_octaves_down", "2 octaves down", "C major"),
    ("two_octaves_major_second_down", "M2 + 2 octaves down", "D major"), ("two_octaves_up", "2 octaves up", "C major"),
]
_CLEF_OF = _values([(x[0], x[3]) for x in INSTRUMENTS], "instrument, clef")
_NOTE_OF = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][1 + {0} % 12] || ({0} // 12 - 1)"


@_query(f"""
select cast(ord as integer) as ord, instrument, name, family, clef, coalesce(sounds, 'concert') as sounds, coalesce(written, 'C major') as c_major_is_written, coalesce({_NOTE_OF.format('low')} || '-' || {_NOTE_OF.format('high')}, '') as "range"
from {_ROSTER} join (select * from {_CLEF_OF}) using (instrument) left join (select * from {_values(_READS, 't, sounds, written')}) on t = transposition
""")
def instrument_listing(spark, d):
    """The roster as the listing prints it."""
    return instrument_table(dimensions.instruments(spark))


@_query(f"select family, cast(min(ord) as integer) as ord, count(*) as n, count(transposition) as n_transposing from {_ROSTER} group by family")
def instrument_families(spark, d):
    """Each family's place in the roster, its instruments and how many of them transpose."""
    roster = dimensions.instruments(spark)
    names = [r.family for r in dimensions.families(spark).collect()]  # eight
    rows = [by_family(roster, f).agg(F.min("ord").alias("ord"), F.count("*").alias("n")).crossJoin(transposing(by_family(roster, f)).agg(F.count("*").alias("n_transposing"))).withColumn("family", F.lit(f)) for f in names]  # single rows
    return reduce(DataFrame.unionByName, rows)


@_query("""
select name, cast(d as integer) as letters, cast(c as integer) as semitones, cast(-d as integer) as back_letters, cast(-c as integer) as back_semitones, cast(d + 14 as integer) as far_letters, cast(c + 24 as integer) as far_semitones, d = 0 and c = 0 as unison
from (values ('unison', 0, 0), ('minor_second', 1, 1), ('major_second', 1, 2), ('minor_third', 2, 3), ('major_third', 2, 4), ('perfect_fourth', 3, 5), ('perfect_fifth', 4, 7), ('minor_sixth', 5, 8), ('major_sixth', 5, 9), ('minor_seventh', 6, 10), ('major_seventh', 6, 11), ('octave', 7, 12)) as v(name, d, c)
""")
def intervals(spark, d):
    """The named intervals, turned round and two octaves wider."""
    rows = []
    for name in INTERVALS:
        i = pitch.interval(name)
        back, far = pitch.negate(*i), pitch.compose(i, pitch.interval("unison"), 2)
        rows.append(F.struct(F.lit(name).alias("name"), *[x.cast("int").alias(n) for n, x in zip(("letters", "semitones", "back_letters", "back_semitones", "far_letters", "far_semitones"), (*i, *back, *far))], pitch.is_unison(*i).alias("unison")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@_query(f"""
with x as (select t, dots, {_BASE_SQL}[i + 1]::hugeint * (2 ** (dots + 1) - 1)::hugeint as num, (2 ** dots)::hugeint as den from (select t, i from {_DUR}), (select unnest(range(5)) as dots))
select t as type, cast(dots as integer) as dots, cast(num // den as bigint) as divisions from x where num % den = 0
""")
def written_durations(spark, d):
    """The written durations that come out whole."""
    return dimensions.durations(spark)


@_query("""
select 'raw/' || file_id || '.mscx' as source_path, 'musicxml/' || file_id || '.musicxml' as target_path from raw_files where file_id % 2 = 0 and file_id % 3 <> 0
""")
def conversion_jobs(spark, d):
    """Mscx files without a MusicXML file yet."""
    ids = _t(spark, d, "raw_files").select("file_id")
    found = ids.select(F.concat(F.lit("raw/"), "file_id", F.when(F.col("file_id") % 2 == 0, F.lit(".mscx")).otherwise(F.lit(".mscz"))).alias("path"))
    done = ids.where("file_id % 3 = 0").select(F.concat(F.lit("musicxml/"), "file_id", F.lit(".musicxml")).alias("path"))
    return corpus.conversion_jobs(found, done)


@_query("""
select source, format, repository is null as manual, 'data/raw/' || source as raw_dir, 'data/corpus/' || source as corpus_dir from (values
  ('bach_chorales', 'kern', ''), ('beethoven_quartets', 'kern', ''), ('inventions', 'kern', ''), ('wtc_fugues', 'kern', ''), ('haydn_quartets', 'kern', ''), ('mozart_quartets', 'kern', ''), ('polish_scores', 'kern', ''),
  ('openscore_lieder', 'musicxml', ''), ('openscore_quartets', 'musicxml', ''), ('pdmx', 'mxl', null)) as v(source, format, repository)
""")
def catalogue(spark, d):
    """The public corpora, where they lie, and which must be fetched by hand."""
    return dimensions.sources(spark).select("source", "format", F.col("repository").isNull().alias("manual"), "raw_dir", "corpus_dir")


# --- vocabulary and tokens ------------------------------------------------------------------------------------------

_VOCAB = f"""
vocab_blocks as (
  select 0 as b, i as j, token from (select unnest(['pad', 'bos', 'eos', 'measure', 'chord', 'tie_start', 'tie_stop', 'rest']) as token, unnest(range(8)) as i)
  union all select 1, range, 'key:' || (range - 7) from range(15)
  union all select 2, n.range * 6 + d.i, 'time:' || (n.range + 1) || ':' || (2 ** d.i)::integer from range(16) n, (select range as i from range(6)) d
  union all select 3, i, 'clef:' || c from (values (0, 'treble'), (1, 'bass'), (2, 'alto'), (3, 'tenor'), (4, 'treble_8vb')) as v(i, c)
  union all select 4, ord, 'instrument:' || instrument from {_ROSTER} where ord < 32
  union all select 5, range, 'part:' || range from range(32)
  union all select 6, o.range * 35 + s.range * 5 + a.range, 'pitch:' || 'CDEFGAB'[s.range + 1] || ':' || (a.range - 2) || ':' || o.range from range(9) o, range(7) s, range(5) a
  union all select 7, i * 3 + dots.range, 'dur:' || t || ':' || dots.range from (select t, i from {_DUR}), range(3) dots where i < 8
  union all select 8, range, 'voice:' || (range + 1) from range(8)
  union all select 9, ord, 'instrument:' || instrument from {_ROSTER} where ord >= 32
  union all select 10, i, 'tuplet:' || r from (select unnest(['3:2', '5:4', '7:4', '9:8']) as r, unnest(range(4)) as i)
  union all select 11, i, 'dur:' || t || ':3' from {_DUR} where i < 8
  union all select 12, i, 'tuplet:' || r from (select unnest(['11:8', '13:8', '15:8']) as r, unnest(range(3)) as i)
  union all select 13, range, 'dur:128th:' || range from range(4)
  union all select 14, i, 'tuplet:' || r from (select unnest(['2:1', '2:3', '4:3', '4:6', '5:2', '5:3', '6:4', '7:1', '7:8']) as r, unnest(range(9)) as i)
  union all select 15, i, 'dur:' || t || ':4' from {_DUR} where i < 9
  union all select 16, i, 'tuplet:' || r from (select unnest(['7:6', '8:2', '9:4', '10:4', '10:8', '11:12', '12:8', '16:8', '22:16', '35:16']) as r, unnest(range(10)) as i)
  union all select 17, t.i * 5 + dots.range, 'dur:' || t.t || ':' || dots.range from (values (0, '256th'), (1, 'long')) as t(i, t), range(5) dots
  union all select 18, i, 'clef:' || c from (select unnest(['soprano', 'mezzo_soprano', 'baritone', 'treble_8va', 'treble_15ma', 'bass_8vb', 'bass_8va', 'french_violin']) as c, unnest(range(8)) as i)),
vocab as (select row_number() over (order by b, j) - 1 as token_id, token from vocab_blocks)
"""


@_query(f"with {_VOCAB} select cast(token_id as integer) as token_id, token from vocab")
def vocab_frozen(spark, d):
    """J10 U1..U4 A11: the whole vocabulary."""
    return dimensions.vocab(spark)


@_query(f"""
with {_VOCAB}, used as (select t as token_id, count(*) as n from (select unnest(tokens) as t from tokens_bin) group by t)
select token_id, token, n from used left join vocab using (token_id)
""")
def token_usage(spark, d):
    """How often each token occurs in the corpus. Counted before the vocabulary is joined."""
    used = _t(spark, d, "tokens_bin").select(F.explode("tokens").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return tokens.spell(used).select("token_id", "token", "n")


@_query(f"""
with t as (select seq_id, unnest(tokens) as id, unnest(generate_series(1, len(tokens))) as pos from tokens_bin where len(tokens) > 0),
c as (select *, sum(case when id = 3 then 1 else 0 end) over w - 1 as m, sum(case when id = 3 or id between 156 and 187 then 1 else 0 end) over w as col from t window w as (partition by seq_id order by pos)),
p as (select *, first_value(case when id between 156 and 187 then id - 156 end) over (partition by seq_id, col order by pos) as part from c)
select seq_id, cast(part as integer) as part_idx, cast(m as bigint) as measure_idx, cast(sum(case when id = 7 or id between 188 and 502 then 1 else 0 end) as bigint) as n_events, cast(sum(case when id = 7 then 1 else 0 end) as bigint) as n_rests
from p where part is not null group by all having n_events > 0
""")
def decoded_events(spark, d):
    """Sequences decoded; the events of each part and measure."""
    _, _, events = tokens.decode(_t(spark, d, "tokens_bin").select("seq_id", "tokens"))
    return events.groupBy("seq_id", "part_idx", (F.col("number") - 1).cast("bigint").alias("measure_idx")).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "rest").alias("n_rests"))


encoded_scores = _query(scores._encoded_sql(_VOCAB))(scores.encoded_scores)


@_query("""
with w as (select seq_id, unnest(generate_series(1, len(tokens) - 64)) as i, tokens from tokens_bin where len(tokens) > 64)
select seq_id, count(*) as n_windows, cast(sum(tokens[i]) as bigint) as first_ids, cast(sum(tokens[i + 64]) as bigint) as last_targets from w group by seq_id
""")
def next_token_windows(spark, d):
    """All windows of 64 ids with their targets, summed by sequence."""
    w = sampling.next_token_windows(_t(spark, d, "tokens_bin").select("seq_id", "tokens"), 64)
    return w.groupBy("seq_id").agg(F.count("*").alias("n_windows"), F.sum(F.get("inputs", F.lit(0))).alias("first_ids"), F.sum(F.element_at("targets", -1)).alias("last_targets"))


@_query("""
with o as (select seq_id, row_number() over (order by seq_id) - 1 as idx from tokens_bin), n as (select count(*) as n from o), s as (select range as i from range(960))
select cast(i // 32 as integer) as step, cast(i % 32 as integer) as slot, seq_id from s, n join o on idx = i % n
""")
def cyclic_batches(spark, d):
    """Thirty batches of 32 in order, starting over at the end."""
    t = _t(spark, d, "tokens_bin").select("seq_id")
    return sampling.cyclic_batches(sampling.dense_index(t, ["seq_id"]), t.count(), 32, 30).select("step", "slot", "seq_id")


@_query("""
with p as (select entry_id, coalesce(tokens, 0) as n, coalesce(sum(coalesce(tokens, 0)) over (order by entry_id rows between unbounded preceding and 1 preceding), 0) as pos from entries)
select entry_id, cast(pos // 2048 as bigint) as first_window, cast(pos % 2048 as bigint) as "offset", cast((pos + greatest(n, 1) - 1) // 2048 as bigint) as last_window from p
""")
def packed_windows(spark, d):
    """Planned packing: sequences laid end to end and cut every 2048 ids."""
    return sampling.packed_windows(_t(spark, d, "entries").select("entry_id", "tokens"), ["entry_id"], 2048).drop("tokens")


@_query("""
select lower(key) as name, file_id, size_bytes from (select *, row_number() over (partition by lower(key) order by starts_with(path, '.'), size_bytes desc, file_id) as r from raw_files) where r = 1
""")
def clean_first(spark, d):
    """Of files with one name the clean one, else the largest."""
    f = _t(spark, d, "raw_files").select(F.lower("key").alias("name"), "file_id", "size_bytes", "path")
    return sampling.clean_first(f, ["name"], F.startswith("path", F.lit(".")), [-F.col("size_bytes"), F.col("file_id")]).drop("path")


@_query()
def sample_sequences(spark, d):
    """The endless sampler, bounded: as many draws with replacement as there are sequences."""
    t = _t(spark, d, "tokens_bin").select("seq_id")
    return sampling.sample_with_replacement(t, ["seq_id"], t.count(), seed=11)


@_query("select count(*) as draws, true as known, true as repeatable from tokens_bin")
def sample_draws(spark, d):
    """The sampler's promises: as many draws as were asked, all of them rows there are, the same again for the same seed."""
    t = _t(spark, d, "tokens_bin").select("seq_id")
    once, again = (sampling.sample_with_replacement(t, ["seq_id"], t.count(), seed=11) for _ in range(2))
    known = once.join(t.withColumnRenamed("seq_id", "k").distinct(), F.col("seq_id") == F.col("k"), "left")
    both = known.join(again.withColumnRenamed("seq_id", "s"), "draw", "full")
    return both.agg(F.count("draw").alias("draws"), F.every(F.col("k").isNotNull()).alias("known"), F.every(F.col("seq_id").eqNullSafe(F.col("s"))).alias("repeatable"))


@_query(f"""
with {scores._CELLS}, n as (select cast(i as varchar) as score_key, 4 + 2 * count(distinct part_idx) - 1 + 2 * count(*) as tokens from notes group by i)
select cast(file_id as varchar) as score_key, cast(n.tokens as bigint) as tokens, case when n.tokens is null then 'no_exclusive_interpretation' end as code from raw_files left join n on n.score_key = cast(file_id as varchar) where content is not null
""")
def stream_ingest(spark, d):
    """S6 R6 as a stream: every listed file read as kern as it arrives, once, to ids or a typed refusal."""
    schema = spark.read.parquet(f"{d}/raw_files.parquet").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/raw_files.parque[t]")
    files = arriving.where("content is not null").select(F.col("file_id").cast("string").alias("path"), "content")
    out = new_path(spark, "stream")
    ingest.start_ingest(files, "kern", out, f"{out}/state").awaitTermination()
    ok = spark.read.schema("score_key string, tokens array<int>").parquet(f"{out}/tokens").select("score_key", F.size("tokens").cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("code"))
    return ok.unionByName(spark.read.schema("score_key string, code string").parquet(f"{out}/errors").select("score_key", F.lit(None).cast("bigint").alias("tokens"), "code"))


@_query("select file_id, regexp_extract(path, '[^/]*$') as name from raw_files")
def base_names(spark, d):
    """the last part of each path."""
    return _t(spark, d, "raw_files").select("file_id", base_name(F.col("path")).alias("name"))
