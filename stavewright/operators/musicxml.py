"""Scores as MusicXML 4.0: one document a row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from stavewright.functions.exact import divisions, plain
from stavewright.functions.fixed import CLEFS, DIVISIONS
from stavewright.sources.kern import DISPLAY
from stavewright.storage import ship

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 4.0 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd">\n<score-partwise version="4.0">\n'


def escape(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = text.replace(raw, safe)
    return text


def _tag(name: str, value: object) -> str:
    return "" if value is None else f"<{name}>{value}</{name}>"


def _ratio(e: dict) -> tuple[int, int] | None:
    return (e["actual"], e["normal"]) if e["actual"] is not None else None


def _length(e: dict) -> int:
    n = divisions(e["dur_type"], e["dots"], _ratio(e))
    if n is None:
        raise ValueError(f"no whole number of divisions: {e['dur_type']} {e['dots']} {_ratio(e)}")
    return n


def brackets(events: list[dict]) -> list[str | None]:
    """For each event whether a tuplet bracket begins (``start``), ends (``stop``) or both there."""
    marks: list[str | None] = [None] * len(events)
    first, total = 0, 0
    for i, e in enumerate(events):
        ratio = _ratio(e)
        if i == first:
            total = 0
        total += 0 if e["chord"] else _length(e)
        follows = i + 1 < len(events) and _ratio(events[i + 1]) == ratio
        if ratio is None or not follows or total > 0 and plain(total):
            if ratio is not None:
                marks[first], marks[i] = ("both",) * 2 if first == i else ("start", "stop")
            first = i + 1
    return marks


def _sides(mark: str | None, both: tuple[str, str]) -> list[str]:
    return [] if mark is None else list(both) if mark == "both" else [mark]


def _event(e: dict, voice: int | None, bracket: str | None) -> str:
    ties = _sides(e["tie"], ("stop", "start"))
    alter = e["alter"] or None
    pitch = "<rest/>" if e["kind"] == "rest" else f"<pitch><step>{e['step']}</step>{_tag('alter', alter)}<octave>{e['octave']}</octave></pitch>"
    ratio = _ratio(e)
    scaled = f"<time-modification><actual-notes>{ratio[0]}</actual-notes><normal-notes>{ratio[1]}</normal-notes></time-modification>" if ratio else ""
    arcs = [f'<tied type="{t}"/>' for t in ties] + [f'<tuplet type="{t}"/>' for t in _sides(bracket, ("start", "stop"))]
    return "".join([
        "<note>", "<chord/>" if e["chord"] else "", pitch, _tag("duration", _length(e)), *[f'<tie type="{t}"/>' for t in ties], _tag("voice", voice),
        _tag("type", e["dur_type"]), "<dot/>" * e["dots"], scaled, f"<notations>{''.join(arcs)}</notations>" if arcs else "", "</note>\n",
    ])


def _toward_zero(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def _element(name: str, *inside: tuple[str, object]) -> str:
    return f"<{name}>{''.join(_tag(x, value) for x, value in inside)}</{name}>\n"


def _attributes(m: dict, transpose: dict | None) -> str:
    """What a measure states, in the order MusicXML wants it; nothing if it states nothing."""
    stated = []
    if m["key"] is not None:
        stated.append(_element("key", ("fifths", m["key"])))
    if m["beats"] is not None:
        stated.append(_element("time", ("beats", m["beats"]), ("beat-type", m["beat_type"])))
    if m["clef"] is not None:
        stated.append(_element("clef", *zip(("sign", "line", "clef-octave-change"), (*CLEFS[m["clef"]][:2], CLEFS[m["clef"]][2] or None))))
    if transpose is not None:
        octaves = _toward_zero(transpose["diatonic"], 7)
        stated.append(_element("transpose", ("diatonic", transpose["diatonic"] - 7 * octaves), ("chromatic", transpose["chromatic"] - 12 * octaves), ("octave-change", octaves or None)))
    return f"<attributes>\n{_tag('divisions', DIVISIONS)}\n{''.join(stated)}</attributes>\n" if stated else ""


def _measure(m: dict, transpose: dict | None) -> str:
    groups = [(v, list(es)) for v, es in groupby(m["events"] or [], key=lambda e: e["voice"])]
    out, rewind = [], None
    for voice, events in groups:
        if rewind is not None:
            out.append(f"<backup><duration>{rewind}</duration></backup>\n")
        out += [_event(e, voice if len(groups) > 1 else None, b) for e, b in zip(events, brackets(events))]
        rewind = sum(_length(e) for e in events if not e["chord"])
    return f'<measure number="{m["number"]}">\n' + _attributes(m, transpose) + "".join(out) + "</measure>\n"


def document(title: str | None, composer: str | None, parts: list[dict]) -> str:
    out = [HEAD]
    if title is not None:
        out.append(f"<work><work-title>{escape(title)}</work-title></work>\n")
    if composer is not None:
        out.append(f'<identification><creator type="composer">{escape(composer)}</creator></identification>\n')
    out.append("<part-list>\n")
    for i, p in enumerate(parts, start=1):
        out.append(f'<score-part id="P{i}"><part-name>{escape(p["name"] or DISPLAY[p["instrument"]])}</part-name></score-part>\n')
    out.append("</part-list>\n")
    for i, p in enumerate(parts, start=1):
        out.append(f'<part id="P{i}">\n' + "".join(_measure(m, p["transpose"] if j == 0 else None) for j, m in enumerate(p["measures"] or [])) + "</part>\n")
    return "".join([*out, "</score-partwise>\n"])


def to_musicxml(scores: DataFrame) -> DataFrame:
    """``(score_key, xml, error)`` of nested scores; one that can't be written has NULL and a reason, refused ones keep theirs out."""
    ship(scores.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("score_key", pa.string()), ("xml", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                try:
                    rows.append({"score_key": s["score_key"], "xml": document(s["title"], s["composer"], s["parts"]), "error": None})
                except (ValueError, KeyError) as e:
                    rows.append({"score_key": s["score_key"], "xml": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return scores.where("parts is not null").select("score_key", "title", "composer", "parts").mapInArrow(run, "score_key string, xml string, error string")
