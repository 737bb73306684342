"""DuckDB SQL that restates the queries, each in another way than its operator."""

from __future__ import annotations

_P2 = r"""
with refs as (
  select instrument, trim(regexp_replace(replace(strip_accents(lower(s)), '♭', 'b'), '[^a-z0-9#]+', ' ', 'g')) as ref
  from (select instrument, unnest(list_prepend(name, aliases)) as s from instruments)),
open as (
  select part_id, name, trim(regexp_replace(replace(strip_accents(lower(name)), '♭', 'b'), '[\s\x{00A0}]+', ' ', 'g')) as n0
  from score_parts where (instrument is null or instrument = 'voice') and regexp_replace(name, '[\s\x{00A0}]+', '', 'g') <> ''),
dist as (select distinct n0 from open),
bare as (
  select n0, trim(regexp_replace(regexp_replace(n0, '^((\d+(st|nd|rd|th)?\.?|solo|principal) )+', ''),
    '( ?([\[(](div\.|solo|tutti|optional|ossia)[\])]|[-/] ?(tutti|ossia)|\*)| part \d+| no\.? ?\d+| (i{1,3}|iv)| ?: ?\d+|_\d+| \d+)+$', '')) as n1 from dist),
spelt as (
  select n0, n1, trim(regexp_replace(n0, '[^a-z0-9#]+', ' ', 'g')) as w0, trim(regexp_replace(n1, '[^a-z0-9#]+', ' ', 'g')) as w1,
    case when regexp_matches(n1, '^[^,(]+[,(][^,()]+\)?\.?$') then trim(regexp_replace(regexp_replace(n1, '^([^,(]+)[,(]([^,()]+)\)?\.?$', '\2 \1'), '[^a-z0-9#]+', ' ', 'g')) end as w2
  from bare),
exact as (select n0, min_by(instrument, ref = w0) as instrument from spelt join refs on ref in (w0, w1, w2) group by n0),
cut as (select n0, min(instrument) as instrument from spelt join refs on starts_with(ref, w1) where ends_with(n1, '.') and length(w1) >= 3 and n0 not in (select n0 from exact) group by n0 having count(distinct instrument) = 1),
tries as (
  select n0, instrument, ref, w, damerau_levenshtein(w, ref) as d, left(ref, 1) <> left(w, 1) as turned
  from (select n0, unnest([w1, w2]) as w from spelt where n0 not in (select n0 from exact) and n0 not in (select n0 from cut)), refs
  where length(w) >= 3 and length(ref) >= 4 and abs(length(w) - length(ref)) <= 2),
-- A slip on the first letter takes more of a name: six letters each, or no change of length.
near as (
  select * from tries where d <= case when length(ref) = 4 then 1 else 2 end
    and (not turned or d <= length(ref) // 6 or d = 1 and length(w) = length(ref))),
fuzzy as (select n0, min_by(instrument, (d, turned, instrument)) as instrument from near group by n0),
mapping as (from exact union all from cut union all from fuzzy)
select part_id, coalesce(m.instrument, 'unmatched') as instrument from open left join mapping m using (n0)
"""

_P3 = r"""
with listed as (
  select distinct seq_id, source, coalesce(case lower(trim(e.format, ' .*')) when 'krn' then 'kern' when 'xml' then 'musicxml' when 'music_xml' then 'musicxml' else lower(trim(e.format, ' .*')) end, s.format) as format
  from (select seq_id, source, format from entries) e join (select source as s, format from sources) s on s = source),
sized as (select * from listed join (select seq_id, coalesce(len(tokens), 0) as n from tokens_bin) using (seq_id)),
members as (
  select 'source' as by_field, source as member, sum(n) as size from (select distinct seq_id, source, n from sized) group by source
  union all select 'format', format, sum(n) from (select distinct seq_id, format, n from sized) group by format)
select mix_id, member from mix_targets left join members using (by_field, member)
where max_repeats * coalesce(size, 0) < target_share * budget_tokens
"""

_P4 = r"""
with runs as (
  select distinct seq_id, tokens[i : i + 4] as s from tokens_bin, unnest(generate_series(1, len(tokens) - 4)) as g(i) where len(tokens) >= 5),
sizes as (select seq_id, count(*) as n from runs group by seq_id),
shared as (select a.seq_id as seq_a, b.seq_id as seq_b, count(*) as c from runs a join runs b on a.s = b.s and a.seq_id < b.seq_id group by all)
select seq_a, seq_b from shared join sizes x on x.seq_id = seq_a join sizes y on y.seq_id = seq_b where c >= 0.6 * (x.n + y.n - c)
"""

_P5 = r"""
with recursive plain as (
  select score_id, lower(strip_accents(composer)) as c, title, lower(regexp_replace(key, '\.[^.]*$', '')) as k from scores),
names as (
  select score_id, trim(regexp_replace(regexp_replace(unnest(string_split_regex(c, ' *[;&/] *')), '^ *composed by ', ''), '\([^)]*\)', '')) as x
  from plain where not regexp_matches(c, '^[\[ ]*(unknown|traditional|trad\.|anon\.|anonymous|n/a|composer|unbekannt|)[\] ]*$')),
parts as (
  select score_id, case when contains(x, ',') then trim(split_part(x, ',', 1)) else split_part(x, ' ', -1) end as family,
    trim(case when contains(x, ',') then split_part(x, ',', 2) else split_part(x, ' ', 1) end, ' .') as given from names),
ties as (
  select score_id, 'k' || k as attr from plain
  union all select score_id, 't' || lower(regexp_extract(title, '\b([B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{5})[ .-]*(?:no\. ?)?([0-9]+)', 1)) || ' ' || regexp_extract(title, '\b([B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{5})[ .-]*(?:no\. ?)?([0-9]+)', 2)
    from plain where regexp_matches(title, '\b([B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{5})[ .-]*(?:no\. ?)?([0-9]+)')
  union all select score_id, 'f' || family || '|' || given from parts where length(given) > 1
  union all select score_id, 'i' || family || '|' || left(given, 1) from parts where (family, left(given, 1)) in (select (family, given) from parts where length(given) = 1)),
edges as (select distinct a.score_id as u, b.score_id as v from ties a join ties b using (attr) where a.score_id <> b.score_id),
reach as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u)
select u as score_id, min(least(u, v)) as group_id from reach group by u
"""

_P6 = r"""
with recursive long as (select seq_id, len(tokens)::bigint as n, list_transform(list_filter(generate_series(1, len(tokens)), lambda i: tokens[i] = 3), lambda i: i - 1) as cuts from tokens_bin where len(tokens) > 1024),
steps as (
  select seq_id, n, cuts, 0::bigint as start_pos, 64::bigint as beyond,
    coalesce(list_max(list_filter(cuts, lambda c: c > 64 and c <= 1024)), 1024)::bigint as end_pos from long
  union all
  select seq_id, n, cuts, s, end_pos, case when n - s <= 1024 then n else coalesce(list_max(list_filter(cuts, lambda c: c > end_pos and c <= s + 1024)), s + 1024) end
  from (select *, coalesce(list_max(list_filter(cuts, lambda c: c > start_pos and c between end_pos - 256 and end_pos - 64)), end_pos - 64)::bigint as s from steps where end_pos < n))
select seq_id, start_pos, end_pos from steps
"""

_SPACE = r"\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\s\x{0B}"
_P7 = rf"""
select doc_id from documents where len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+')) > 2048
"""

# The text as TESTDATA.md has it come out, by a map of its own: only the characters it names, written down apart from the operator's.
_LOOKS = {
    "ABEKMHOPCTXYISJ": "АВЕКМНОРСТХҮІЅЈ",
    "aeopcyxisjhd": "аеорсухіѕјһԁ",
    "ABEZHIKMNOPTYXo": "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
    "vpuY": "νρυУ",
}
_WIDE = "".join(chr(0x21 + i) for i in range(94))


def _seen(text: str) -> str:
    plain, other = "".join(_LOOKS) + _WIDE + "    ", "".join(_LOOKS.values()) + "".join(chr(0xFF01 + i) for i in range(94)) + "   　"
    quoted = plain.replace("'", "''")
    bare = f"regexp_replace({text}, '[­​-‏⁠-⁤﻿͏]', '', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({bare}), '{other}', '{quoted}'))"


_P8 = rf"""
with d as (select doc_id, regexp_extract_all(lower({_seen('text')}), '[\p{{L}}\p{{N}}]+') as w from documents where text <> ''),
e as (select item_id, regexp_extract_all(lower({_seen('text')}), '[\p{{L}}\p{{N}}]+') as w from eval_items where text <> ''),
dr as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') as r from d, unnest(generate_series(1, len(w) - 11)) as g(i) where len(w) >= 12),
er as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as r from e, unnest(generate_series(1, len(w) - 11)) as g(i) where len(w) >= 12)
select distinct doc_id, item_id from dr join er using (r)
"""

_P9 = rf"""
with f as (select doc_id, text, {_seen('text')} as form from documents where text <> '')
select a.doc_id as doc_a, b.doc_id as doc_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id
"""

_P9_CLASSES = rf"""
with f as (select doc_id, text, {_seen('text')} as form from documents where text <> ''),
c as (select doc_id, min(doc_id) over (partition by form) as class_id, min(doc_id) over (partition by form, text) as spelling_id, min(text) over (partition by form) <> max(text) over (partition by form) as several from f)
select doc_id, class_id, spelling_id from c where several
"""

_P4_CLASSES = _P4.rsplit("select seq_a", 1)[0].rstrip() + r""",
sets as (select seq_id, list_sort(list(s)) as x from runs group by seq_id),
classes as (select seq_id, min(seq_id) over (partition by x) as class_id from sets),
pairs as (select seq_a, seq_b from shared join sizes x on x.seq_id = seq_a join sizes y on y.seq_id = seq_b where c >= 0.6 * (x.n + y.n - c)),
links as (select distinct p.class_id as a, q.class_id as b from pairs join classes p on p.seq_id = seq_a join classes q on q.seq_id = seq_b where p.class_id <> q.class_id),
ends as (select least(a, b) as a, greatest(a, b) as b from links),
degree as (select class_id, count(*) as n from (select distinct a, b, unnest([a, b]) as class_id from ends) group by class_id)
select seq_id, class_id, coalesce(n, 0) as n_links from classes left join degree using (class_id)
"""

# Reached shares are drawn; what holds of every draw is stated.
_P3_BALANCE = _P3.rsplit("select mix_id, member from", 1)[0].replace("sum(n) as size", "sum(n) as size, count(*) as docs").replace("sum(n) from", "sum(n), count(*) from") + r"""
select mix_id, member, coalesce(docs, 0) as n_docs, cast(coalesce(size, 0) as bigint) as n_tokens, max_repeats * coalesce(size, 0) >= target_share * budget_tokens as reachable, true as repeats_kept, true as share_kept
from mix_targets left join members using (by_field, member)
"""

_P5_BALANCE = _P5.rsplit("select u as score_id", 1)[0] + r"""
select split, share, (select count(*) from scores) as all_rows, coalesce((select max(n) from (select count(*) as n from (select u, min(least(u, v)) as g from reach group by u) group by g)), 1) as largest_group, true as kept, cast(0 as bigint) as parted_groups
from (values ('train', 0.9::double), ('validation', 0.05), ('test', 0.05)) as v(split, share)
"""

_P7_FILL = rf"""
select count(*) as n_docs, cast(0 as bigint) as n_wrong, cast(sum(n) as bigint) as tokens, true as fits, true as tight
from (select coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+')), 0) as n from documents)
"""

ORACLES = {
    "p2_found": _P2, "p3_found": _P3, "p3_balance": _P3_BALANCE, "p4_found": _P4, "p4_classes": _P4_CLASSES, "p5_found": _P5, "p5_balance": _P5_BALANCE, "p6_found": _P6, "p7_found": _P7, "p7_fill": _P7_FILL,
    "p8_found": _P8, "p9_found": _P9, "p9_classes": _P9_CLASSES,
}
