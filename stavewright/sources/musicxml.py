"""MusicXML (plain and zipped): document to score, through a SAX reader that keeps sibling order."""

from __future__ import annotations

import io
import re
import xml.sax
import zipfile

from stavewright.functions.exact import plain, rests
from stavewright.functions.fixed import CLEFS, DIVISIONS, STEPS, TYPES
from stavewright.functions.schema import Refusal, event
from stavewright.sources.kern import find_instrument

_CLEF_OF = {v: k for k, v in CLEFS.items()}


class _Reader(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.path: list[str] = []
        self.text = ""
        self.title = self.composer = self.creator = None
        self.listed: dict[str, str] = {}
        self.order: list[str] = []
        self.declaring = self.part = self.measure = self.note = None
        self.measures: dict[str, list[dict]] = {}
        self.divisions = DIVISIONS

    # Elements that only matter inside a note.
    def _begin_note(self, name: str, attrs) -> None:
        n = self.note
        if name in ("chord", "rest", "grace"):
            n[name] = True
        elif name == "tie":
            n["ties"].append(attrs.get("type"))
        elif name == "dot":
            n["dots"] += 1

    def startElement(self, name: str, attrs) -> None:
        self.path.append(name)
        self.text = ""
        if name == "score-part":
            self.declaring = attrs.get("id")
        elif name == "part":
            self.part = attrs.get("id")
        elif name == "creator":
            self.creator = attrs.get("type")
        elif name == "measure":
            stated = re.match(r"[+-]?\d+", attrs.get("number", ""))
            number = int(stated[0]) if stated else len(self.measures.get(self.part, [])) + 1
            self.measure = {"number": number, "key": None, "beats": None, "beat_type": None, "clef": None}
            self.entries, self.at, self.chord_at = [], 0, 0
        elif name == "note":
            self.note = {"dots": 0, "ties": [], "chord": False, "rest": False, "grace": False, "alter": 0, "voice": 1}
        elif self.note is not None:
            self._begin_note(name, attrs)

    def characters(self, content: str) -> None:
        self.text += content

    def endElement(self, name: str) -> None:
        text, self.text = self.text.strip(), ""
        parent = self.path[-2] if len(self.path) > 1 else None
        self.path.pop()
        if name == "note":
            self._end_note()
        elif self.note is not None:
            self._note_value(name, text)
        elif self.measure is not None:
            self._measure_value(name, text, parent)
        elif name == "work-title":
            self.title = text
        elif name == "creator" and self.creator == "composer":
            self.composer = text
        elif name == "part-name" and self.declaring is not None:
            self.listed[self.declaring] = text
            self.order.append(self.declaring)
        elif name == "score-part":
            self.declaring = None
        elif name == "divisions":
            self.divisions = int(text)

    def _note_value(self, name: str, text: str) -> None:
        numbers = {"alter": "alter", "octave": "octave", "duration": "length", "voice": "voice", "actual-notes": "actual", "normal-notes": "normal"}
        if name in numbers:
            self.note[numbers[name]] = int(text)
        elif name == "step":
            if text not in STEPS:
                raise Refusal("bad_step", text)
            self.note["step"] = text
        elif name == "type":
            if text not in TYPES:
                raise Refusal("unsupported_type", text)
            self.note["type"] = text

    def _measure_value(self, name: str, text: str, parent: str | None) -> None:
        m = self.measure
        if name == "divisions":
            self.divisions = int(text)
        elif name == "fifths":
            m["key"] = int(text)
        elif name in ("beats", "beat-type"):
            if not re.fullmatch(r"[+-]?\d+", text):
                raise Refusal("bad_time", f"{name} {text}")
            if name == "beats":
                m["beats"], m["beat_type"] = int(text), m["beat_type"] or 4
            else:
                m["beats"], m["beat_type"] = 4 if m["beats"] is None else m["beats"], int(text)
        elif name == "sign" and parent == "clef":
            m["clef"] = (text, 2, 0)
        elif name == "line" and parent == "clef":
            m["clef"] = (m["clef"][0], int(text), m["clef"][2])
        elif name == "clef-octave-change":
            m["clef"] = (*m["clef"][:2], int(text))
        elif name == "duration" and parent in ("backup", "forward"):
            self.at += int(text) if parent == "forward" else -int(text)
        elif name == "measure":
            self._end_measure()

    def _ours(self, length: int) -> int | None:
        n, rest = divmod(length * DIVISIONS, self.divisions)
        return None if rest else n

    def _events(self, n: dict) -> list[dict]:
        ratio = (n["actual"], n["normal"]) if n.get("actual") is not None and n.get("normal") is not None else None
        span = self._ours(n["length"])
        if n["rest"]:
            if "type" in n:
                return [event("rest", n["type"], n["dots"], ratio, voice=n["voice"])]
            made = None if span is None else rests(span)
            if made is None:
                raise Refusal("unrepresentable_rest", n["length"])
            return [event("rest", *x, voice=n["voice"]) for x in made]
        if "step" not in n:
            raise Refusal("unpitched_note")
        if "type" in n:
            kind, dots = n["type"], n["dots"]
        elif span is None or (found := plain(span)) is None:
            raise Refusal("unnotatable_duration", n["length"])
        else:
            kind, dots = found
        ties = n["ties"]
        if len(ties) > 2:
            raise ValueError("more than two ties on a note")
        tie = "both" if len(ties) == 2 else ties[0] if ties else None
        return [event("note", kind, dots, ratio, step=n["step"], alter=n["alter"], octave=n["octave"], tie=tie, chord=n["chord"], voice=n["voice"])]

    def _end_note(self) -> None:
        n, self.note = self.note, None
        if n["grace"]:
            return
        if "length" not in n:
            raise Refusal("missing_duration_element", n.get("step", "rest"))
        made = self._events(n)
        if n["chord"]:
            self.entries.append((self.chord_at, n["length"], made))
        else:
            self.entries.append((self.at, n["length"], made))
            self.chord_at, self.at = self.at, self.at + n["length"]

    def _end_measure(self) -> None:
        m, self.measure = self.measure, None
        events, where = [], f"measure {m['number']}"
        by_voice: dict[int, list] = {}
        for entry in self.entries:
            by_voice.setdefault(entry[2][0]["voice"], []).append(entry)
        for dense, own in enumerate(by_voice.values(), start=1):
            end = 0
            for at, length, made in own:
                chord = made[0]["chord"]
                if not chord and at < end:
                    raise Refusal("overlapping_voice", f"voice {dense}, {where}")
                if not chord and at > end:
                    span = self._ours(at - end)
                    pad = None if span is None else rests(span)
                    if pad is None:
                        raise Refusal("unrepresentable_offset", f"gap {at - end}, {where}")
                    events += [event("rest", *x, voice=dense) for x in pad]
                events += [e | {"voice": dense} for e in made]
                end = end if chord else at + length
        if m["clef"] is not None:
            if m["clef"] not in _CLEF_OF:
                raise Refusal("unsupported_clef", " ".join(map(str, m["clef"])))
            m["clef"] = _CLEF_OF[m["clef"]]
        self.measures.setdefault(self.part, []).append(m | {"events": events})


def parse(document: bytes | str) -> dict:
    """The score of a MusicXML document; raises Refusal, for malformed XML too (code ``other``)."""
    reader = _Reader()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setFeature(xml.sax.handler.feature_external_pes, False)
    parser.setContentHandler(reader)
    source = xml.sax.InputSource()
    source.setByteStream(io.BytesIO(document.encode() if isinstance(document, str) else document))
    try:
        parser.parse(source)
    except xml.sax.SAXException as e:
        raise Refusal("other", e) from e
    parts = [{"instrument": find_instrument(reader.listed[i]) or "voice", "name": reader.listed[i], "transpose": None, "measures": reader.measures.get(i, [])} for i in reader.order]
    return {"title": reader.title, "composer": reader.composer, "parts": parts}


def unzip(content: bytes, key: str) -> bytes:
    """The score inside an mxl file: its first member outside META-INF that ends in .xml or .musicxml."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if not name.startswith("META-INF") and name.endswith((".xml", ".musicxml")):
                    return z.read(name)
    except zipfile.BadZipFile as e:
        raise Refusal("mxl_unzip_failed", e) from e
    raise Refusal("mxl_no_score_member", key)
