"""Engraving by external programs, where they are installed."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from stavewright.storage import ship

RENDERERS = ("verovio", "rsvg-convert", "lilypond")


def available() -> dict[str, bool]:
    return {x: shutil.which(x) is not None for x in RENDERERS}


def svg_pages(xml: str) -> tuple[list[str] | None, str | None]:
    """The pages of a document in order, or a typed reason why there are none."""
    if not available()["verovio"]:
        return None, "renderer_not_found"
    with tempfile.TemporaryDirectory() as folder:
        source, out = Path(folder, "score.musicxml"), Path(folder, "page.svg")
        source.write_text(xml)
        ran = subprocess.run(["verovio", "-o", str(out), "--all-pages", str(source)], capture_output=True, timeout=300)
        if ran.returncode:
            return None, "verovio_failed"
        pages = [p.read_text() for p in sorted(Path(folder).glob("page*.svg"))]
        return (pages, None) if pages else (None, "no_output_produced")


def pdf_pages(xml: str) -> tuple[bytes | None, str | None]:
    """The document as PDF, or the reason why not."""
    if not available()["rsvg-convert"]:
        return None, "renderer_not_found"
    pages, why = svg_pages(xml)
    if why:
        return None, why
    with tempfile.TemporaryDirectory() as folder:
        files = [Path(folder, f"{i:06d}.svg") for i in range(len(pages))]
        for f, page in zip(files, pages):
            f.write_text(page)
        ran = subprocess.run(["rsvg-convert", "-f", "pdf", *map(str, files)], capture_output=True, timeout=300)
        return (ran.stdout, None) if ran.returncode == 0 and ran.stdout else (None, "rsvg_failed")


def _render(documents: DataFrame, column: str, kind: str, one) -> DataFrame:
    ship(documents.sparkSession)
    ddl = f"score_key string, {column} {kind}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("score_key", pa.string()), (column, pa.list_(pa.string()) if kind == "array<string>" else pa.binary()), ("error", pa.string())])
        for batch in batches:
            rows = [dict(zip(schema.names, (r["score_key"], *one(r["xml"])))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.where("xml is not null").select("score_key", "xml").mapInArrow(run, ddl)


def render_svg(documents: DataFrame) -> DataFrame:
    """``(score_key, pages, error)`` of ``(score_key, xml)``."""
    return _render(documents, "pages", "array<string>", svg_pages)


def render_pdf(documents: DataFrame) -> DataFrame:
    """``(score_key, pdf, error)`` of ``(score_key, xml)``."""
    return _render(documents, "pdf", "binary", pdf_pages)
