"""Problem 2: free-entered part names mapped to the instruments they mean.

A pigeonhole join in SQL. A reference string is cut into segments; whoever typed it
with at most k slips left at least one segment whole, at most k places from where it
was. So names and references are joined by equality on (length, segment, substring)
and only the few pairs that meet are verified with ``levenshtein``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stavewright.storage import materialize

# What engravers put around an instrument's name.
PREFIX = r"^(?:(?:[0-9]+(?:st|nd|rd|th)?[.]?|solo|principal)\s+)+"
SUFFIX = (
    r"(?:\s*(?:[\[(](?:div[.]?|solo|tutti|optional|ossia)[\])]|[-/]\s*(?:tutti|ossia|div[.]?|solo)|[*])"
    r"|\s+part\s+[0-9]+|\s+no[.]?\s*[0-9]+|\s+(?:i{{1,3}}|iv|vi{{0,3}}|ix|x)|\s*:\s*[0-9]+|_[0-9]+|\s+[0-9]+)+$"
)
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ♭♯"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyb#"
SPACES = r"[\s\u00A0\u2007\u202F\u3000]+"


def _fold(x: str) -> str:
    return f"translate(lower(trim(regexp_replace({x}, r'{SPACES}', ' '))), '{ACCENTED}', '{PLAIN}')"


def _letters(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9#]+', ' '))"


def _sorted(x: str) -> str:
    return f"array_join(array_sort(split({x}, '')), '')"


_OPEN = f"""
SELECT part_id, name FROM {{parts}}
WHERE (instrument IS NULL OR instrument = 'voice') AND part_id IS NOT NULL
  AND regexp_replace(name, r'{SPACES}', '') <> ''
"""

_REFS = f"""
SELECT ref, min(instrument) AS instrument FROM (
  SELECT {_letters(_fold('spelling'))} AS ref, instrument
  FROM (SELECT instrument, explode(concat(array(name), coalesce(aliases, array()))) AS spelling FROM {{entries}} WHERE instrument IS NOT NULL)
) WHERE ref <> '' GROUP BY ref
"""

# One row a distinct name: what it may spell, as typed (0), without decoration (1), turned round (2: "voice (bass)").
_NAMES = f"""
WITH distinct_names AS (SELECT name FROM {{open}} GROUP BY name),
folded AS (SELECT name, {_fold('name')} AS n0 FROM distinct_names),
bare AS (SELECT name, n0, trim(regexp_replace(regexp_replace(n0, r'{PREFIX}', ''), r'{SUFFIX}', '')) AS n1 FROM folded)
SELECT name, how, spelt, endswith(n1, '.') AS cut FROM (
  SELECT name, n1, stack(3,
    0, {_letters('n0')},
    1, {_letters('n1')},
    2, CASE WHEN n1 rlike '^[^,(]+[,(][^,()]+[)]?[.]?$' THEN {_letters("regexp_replace(n1, '^([^,(]+)[,(]([^,()]+)[)]?[.]?$', '$2 $1')")} END) AS (how, spelt)
  FROM bare) WHERE spelt <> ''
"""

_EXACT = """
SELECT name, min_by(instrument, how) AS instrument FROM {names} JOIN {refs} ON spelt = ref GROUP BY name
"""

# "klavi." stands for the one instrument whose name begins so.
_CUT = """
SELECT name, min(instrument) AS instrument FROM (
  SELECT n.name, r.instrument FROM (SELECT * FROM {names} WHERE cut AND how = 1 AND length(spelt) >= 3) n
  JOIN (SELECT instrument, explode(transform(sequence(3, length(ref)), i -> left(ref, i))) AS beginning FROM {refs} WHERE length(ref) >= 3) r
  ON n.spelt = r.beginning
  LEFT ANTI JOIN {exact} e ON n.name = e.name)
GROUP BY name HAVING count(DISTINCT instrument) = 1
"""

# A slip is a letter wrong, missing, added, or two neighbours exchanged. References of three letters and less allow
# none, of four letters one, longer ones two. An exchange touches up to two segments, hence 2k+1 of them; only missing
# and added letters move what follows, by one place each. Foreign instruments are often a first letter and a slip from
# listed ones (sitar, kalimba, lute), so with another initial a slip takes six letters of the reference; a lone one that
# leaves the length as it is (a letter wrong, the first two exchanged) is forgiven at any length.
_FUZZY = f"""
WITH probes AS (
  SELECT DISTINCT n.name, n.spelt FROM {{names}} n
  LEFT ANTI JOIN {{exact}} e ON n.name = e.name LEFT ANTI JOIN {{cut}} c ON n.name = c.name
  WHERE n.how > 0 AND length(n.spelt) >= 3),
cuts AS (
  SELECT ref, instrument, length(ref) AS len, k, s, 1 + div(s * length(ref), 2 * k + 1) AS at, div((s + 1) * length(ref), 2 * k + 1) - div(s * length(ref), 2 * k + 1) AS n
  FROM (SELECT ref, instrument, CASE WHEN length(ref) = 4 THEN 1 ELSE 2 END AS k FROM {{refs}} WHERE length(ref) >= 4)
  LATERAL VIEW explode(sequence(0, 2 * k)) AS s),
segments AS (SELECT ref, instrument, len, s, substr(ref, at, n) AS piece FROM cuts),
lengths AS (SELECT name, spelt, len, CASE WHEN len = 4 THEN 1 ELSE 2 END AS k FROM probes LATERAL VIEW explode(sequence(greatest(4, length(spelt) - 2), length(spelt) + 2)) AS len),
windows AS (
  SELECT name, spelt, len, s, 1 + div(s * len, 2 * k + 1) + shift AS at, div((s + 1) * len, 2 * k + 1) - div(s * len, 2 * k + 1) AS n
  FROM lengths LATERAL VIEW explode(sequence(0, 2 * k)) AS s LATERAL VIEW explode(sequence(-k, k)) AS shift),
pieces AS (SELECT DISTINCT name, spelt, len, s, substr(spelt, at, n) AS piece FROM windows WHERE at >= 1 AND at + n - 1 <= length(spelt)),
met AS (SELECT DISTINCT p.name, p.spelt, g.ref, g.instrument FROM pieces p JOIN segments g USING (len, s, piece)),
measured AS (SELECT name, ref, instrument, length(ref) AS n, left(spelt, 1) <> left(ref, 1) AS other, levenshtein(spelt, ref) AS d, levenshtein({_sorted('spelt')}, {_sorted('ref')}) AS letters, abs(length(spelt) - length(ref)) AS longer FROM met),
judged AS (
  SELECT name, instrument, d, other,
    CASE WHEN d <= 1 THEN d WHEN d = 2 AND letters = 0 THEN 1 WHEN d = 2 THEN 2
         WHEN d = 3 AND letters <= 2 AND longer <= 1 THEN 2 WHEN d = 4 AND letters = 0 THEN 2 END AS slips,
    CASE WHEN other THEN greatest(least(div(n, 6), 2), CASE WHEN longer = 0 THEN 1 ELSE 0 END) WHEN n = 4 THEN 1 ELSE 2 END AS allowed
  FROM measured)
SELECT name, min_by(instrument, struct(slips, other, d, instrument)) AS instrument FROM judged WHERE slips <= allowed GROUP BY name
"""

_MAPPED = """
SELECT o.part_id, m.instrument FROM {open} o JOIN {mapping} m ON o.name = m.name
UNION ALL
SELECT o.part_id, 'unmatched' AS instrument FROM {open} o LEFT ANTI JOIN {mapping} m ON o.name = m.name
"""


def match_names(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """``(part_id, instrument)`` for each row of ``parts`` the ingest did not recognise.

    ``parts`` has ``part_id, name, instrument``, ``entries`` has ``instrument, name,
    aliases``; other columns of either play no part. Rows whose ``instrument`` is NULL
    or ``voice`` and whose name is neither NULL nor blank get the id of the entry they
    mean, else ``unmatched``. A name is read as typed, then without numbering and
    directions, then with "bass, double" turned round; spelling a reference wins over
    abbreviating it ("klavi."), which wins over misspelling it. A misspelt name that
    begins with another letter is allowed fewer slips, by its length; of several entries
    the fewest slips win, then the right first letter, then the smaller Levenshtein
    distance, then the smaller id. An abbreviation that fits two
    instruments counts as misspelt. Two entries with one spelling: the smaller id.
    An empty reference list leaves every name unmatched; very long names match nothing.

    Work is done once per distinct name, so a name borne by a third of all rows costs
    one probe; the rows meet the mapping in an equi-join whose skew AQE splits.
    """
    spark = parts.sparkSession
    todo = spark.sql(_OPEN, parts=parts)
    refs = materialize(spark.sql(_REFS, entries=entries), "refs")
    names = materialize(spark.sql(_NAMES, open=todo), "names")
    exact = materialize(spark.sql(_EXACT, names=names, refs=refs), "exact")
    cut = materialize(spark.sql(_CUT, names=names, refs=refs, exact=exact), "cut")
    fuzzy = spark.sql(_FUZZY, names=names, refs=refs, exact=exact, cut=cut)
    mapping = materialize(exact.unionByName(cut).unionByName(fuzzy), "mapping")
    return spark.sql(_MAPPED, open=todo, mapping=mapping)
