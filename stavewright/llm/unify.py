"""Problem 9: visually identical text with different characters.

The consistent form is made by DuckDB inside Arrow partitions: ``regexp_replace``
takes invisible characters out, ``nfc_normalize`` composes accents, ``translate`` maps
full-width forms, special spaces and look-alike letters. The text itself never
leaves its partition unless it is asked for; comparisons travel as two digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.llm.tidy import tidy_sql
from stavewright.storage import materialize, ship


def _through_duckdb(select: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for batch in batches:
            rows = pa.Table.from_batches([batch])  # noqa: F841 (DuckDB reads it by name)
            yield from db.sql(f"SELECT {select} FROM rows").to_arrow_table().cast(schema).to_batches()
        db.close()

    return run


def unify(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """``(doc_id, text, raw_digest, form_digest)``: the consistent form of each text and MD5s of both.

    NULL text stays NULL with NULL digests, empty text stays empty. Case, line breaks
    and ordinary spaces and punctuation stay. Columns other than ``doc_id`` and
    ``text`` are left behind; without ``keep_text`` the form is too. The form is meant
    for comparing: words of another script that are spelt with look-alikes change too.
    """
    ship(documents.sparkSession)
    form = tidy_sql("text")
    select = f"doc_id, {'f AS text, ' if keep_text else ''}md5(text) AS raw_digest, md5(f) AS form_digest"
    fields = [pa.field("doc_id", pa.int64()), *([pa.field("text", pa.string())] if keep_text else []), pa.field("raw_digest", pa.string()), pa.field("form_digest", pa.string())]
    run = _through_duckdb(select.replace("md5(f)", f"md5({form})").replace("f AS text", f"{form} AS text"), pa.schema(fields))
    kinds = "doc_id bigint, " + ("text string, " if keep_text else "") + "raw_digest string, form_digest string"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, kinds)


def _mixed(documents: DataFrame) -> DataFrame:
    """``(doc_id, raw_digest, form_digest)`` of the texts whose form is spelt in more than one way."""
    digests = materialize(unify(documents.where("text is not null and text <> '' and doc_id is not null"), keep_text=False), "forms")
    mixed = digests.groupBy("form_digest").agg(F.min("raw_digest").alias("lo"), F.max("raw_digest").alias("hi")).where("lo <> hi").select("form_digest")
    return materialize(digests.join(mixed, "form_digest", "left_semi").distinct(), "mixed")


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, class_id, spelling_id)``: a row a document, so copies are never expanded into pairs.

    Documents of one ``class_id`` (its smallest ``doc_id``) have one consistent form,
    those of one ``spelling_id`` (the smallest ``doc_id`` with that text) are exact
    copies; any two spellings of a class are a link. Forms with a single spelling,
    empty and NULL texts and NULL ids are left out.
    """
    rows = _mixed(documents)
    forms = rows.groupBy("form_digest").agg(F.min("doc_id").alias("class_id"))
    spellings = rows.groupBy("form_digest", "raw_digest").agg(F.min("doc_id").alias("spelling_id"))
    return rows.join(spellings, ["form_digest", "raw_digest"]).join(forms, "form_digest").select("doc_id", "class_id", "spelling_id")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)``: non-empty texts that differ as stored but have one consistent form.

    Forms with a single stored spelling, whatever the number of its copies, are left
    out by an aggregate before any pairing, so exact copies meet nobody. The pairs of
    the rest are the result itself; :func:`lookalike_classes` says the same in a row a
    document. Repeated rows count once. NULL ids pair with nobody.
    """
    rows = _mixed(documents)
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.expr("a.form_digest = b.form_digest AND a.raw_digest <> b.raw_digest AND a.doc_id < b.doc_id")).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))
