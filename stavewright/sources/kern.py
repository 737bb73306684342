"""Humdrum kern: text to score. Sequential within a file by nature, so files are the unit of parallelism.

Decisions, each with a test: ``3%2`` reads as 3; ``0000`` as a breve; two splits of one
part in one line get the same new voice; adjacent merges join whatever parts they are
of; a second ``**`` line starts the parts anew but not the measure count; short lines
end early; every line that starts with ``=`` ends a measure that holds something.
"""

from __future__ import annotations

import re

from stavewright.functions.exact import divisions, rests
from stavewright.functions.fixed import INSTRUMENTS, KERN_CLEFS, MAX_VOICES, TUPLET_ACTUALS, TYPES
from stavewright.functions.schema import Refusal, event

_RECIP = re.compile(r"(\d+)(\.*)")
_LETTERS = re.compile(r"[a-g]+|[A-G]+")
_METER = re.compile(r"\*M([+-]?\d+)/([+-]?\d+)$")
# Powers of two that kern can name, from 0 (a breve).
_KERN_TYPES = dict(zip([0, 1, 2, 4, 8, 16, 32, 64, 128], TYPES))

NAMES: dict[str, str] = {}
for _x in reversed(INSTRUMENTS):
    for _n in (_x[1], *_x[7]):
        NAMES[re.sub("[^a-z0-9#]", "", _n.lower().replace("♭", "b").replace("♯", "#"))] = _x[0]
DISPLAY = {x[0]: x[1] for x in INSTRUMENTS}


def find_instrument(name: str) -> str | None:
    return NAMES.get(re.sub("[^a-z0-9#]", "", name.lower().replace("♭", "b").replace("♯", "#")))


class _Part:
    def __init__(self):
        self.instrument = self.name = None
        self.measures: list[dict] = []
        self.begin()

    def begin(self):
        self.attributes = {"key": None, "beats": None, "beat_type": None, "clef": None}
        self.voices: dict[int, list[dict]] = {}
        self.spent: dict[int, int] = {}
        self.entered: dict[int, int] = {}

    def end_measure(self, number: int):
        events = []
        for dense, (voice, own) in enumerate(sorted((v, e) for v, e in self.voices.items() if e), start=1):
            late = rests(self.entered.get(voice, 0))
            if late is None:
                raise ValueError(f"a voice enters after {self.entered[voice]} divisions, which no rests make up")
            events += [event("rest", t, dots, ratio, voice=dense) for t, dots, ratio in late]
            events += [e | {"voice": dense} for e in own]
        self.measures.append({"number": number, **self.attributes, "events": events})
        self.begin()


def _duration(text: str) -> tuple[str, int, tuple[int, int] | None]:
    found = _RECIP.search(text)
    if not found:
        raise Refusal("missing_duration", text)
    digits, dots = found[1], len(found[2])
    if digits == "00":
        kind, ratio = "long", None
    elif digits == "000":
        raise Refusal("unsupported_duration", "maxima")
    else:
        number = int(digits)
        odd = number // (number & -number) if number else 1
        ratio, base = None, number
        if odd > 1:
            if odd not in TUPLET_ACTUALS:
                raise Refusal("unsupported_tuplet", odd)
            ratio = (odd, 1 << (odd.bit_length() - 1))
            base = number // odd * ratio[1]
        kind = _KERN_TYPES.get(base)
        if kind is None:
            raise Refusal("unsupported_duration", number)
    if divisions(kind, dots, ratio) is None:
        raise Refusal("unrepresentable_duration", found[0])
    return kind, dots, ratio


def _note(text: str, chord: bool) -> dict:
    timing = _duration(text)
    letters = _LETTERS.search(text)
    # Invisible and without a pitch: a spacer rest, however it is spelt.
    if "r" in text or "yy" in text and not letters:
        return event("rest", *timing)
    if not letters:
        raise Refusal("missing_pitch", text)
    run = letters[0]
    octave = 3 + len(run) if run.islower() else 4 - len(run)
    alter = text.count("#") or -text.count("-")
    opens, closes = "[" in text, "]" in text
    tie = "both" if "_" in text or opens and closes else "start" if opens else "stop" if closes else None
    return event("note", *timing, step=run[0].upper(), alter=alter, octave=octave, tie=tie, chord=chord)


def _data(field: str) -> list[dict]:
    if field == ".":
        return []
    sounding = [x for x in field.split(" ") if x and "q" not in x and "Q" not in x]
    return [_note(x, i > 0) for i, x in enumerate(sounding)]


def _interpret(part: _Part, field: str) -> None:
    if field.startswith('*I"'):
        part.name = field[3:]
        part.instrument = find_instrument(part.name) or "voice"
    elif field.startswith("*I"):
        part.instrument = find_instrument(field[2:]) or part.instrument
    elif field.startswith("*clef"):
        part.attributes["clef"] = KERN_CLEFS.get(field[5:])
    elif field.startswith("*k["):
        part.attributes["key"] = field.count("#") or -field.count("-")
    elif not field.startswith("*MM") and (meter := _METER.match(field)):
        part.attributes |= {"beats": int(meter[1]), "beat_type": int(meter[2])}


class _File:
    def __init__(self):
        self.columns: list[tuple[int | None, int]] | None = None
        self.parts: list[_Part] = []
        self.number = 0

    def header(self, fields: list[str]) -> None:
        self.parts, self.columns = [], []
        for f in fields:
            if f == "**kern":
                self.columns.append((len(self.parts), 1))
                self.parts.append(_Part())
            else:
                self.columns.append((None, 1))
        if not self.parts:
            raise Refusal("unsupported_spines", "\t".join(fields))

    def end_measure(self) -> None:
        if any(e for p in self.parts for e in p.voices.values()):
            self.number += 1
            for p in self.parts:
                p.end_measure(self.number)

    def reshape(self, fields: list[str]) -> None:
        after, merging = [], False
        for (part, voice), f in zip(self.columns, fields):
            if f == "*v" and merging:
                continue
            merging = f == "*v"
            after.append((part, voice))
            if f == "*^":
                if part is None:
                    after.append((part, voice))
                else:
                    new = 1 + max(v for p, v in self.columns if p == part)
                    if new > MAX_VOICES:
                        raise Refusal("unsupported", f"too_many_voices {new}")
                    own = self.parts[part]
                    own.entered[new] = own.spent[new] = own.spent.get(voice, 0)
                    after.append((part, new))
            elif f != "*v" and part is not None:
                _interpret(self.parts[part], f)
        self.columns = after

    def line(self, text: str) -> None:
        fields = text.split("\t")
        if text.startswith("**"):
            self.header(fields)
        elif self.columns is None:
            return
        elif text.startswith("*"):
            if "*-" in fields:
                self.end_measure()
            elif "*x" in fields or "*+" in fields:
                raise Refusal("unsupported", "spine_manipulation")
            elif "*^" in fields or "*v" in fields:
                self.reshape(fields)
            else:
                for (part, _), f in zip(self.columns, fields):
                    if part is not None:
                        _interpret(self.parts[part], f)
        elif text.startswith("="):
            self.end_measure()
        else:
            for (part, voice), f in zip(self.columns, fields):
                if part is not None:
                    own, events = self.parts[part], _data(f)
                    own.voices.setdefault(voice, []).extend(events)
                    own.spent[voice] = own.spent.get(voice, 0) + sum(divisions(e["dur_type"], e["dots"], (e["actual"], e["normal"]) if e["actual"] else None) for e in events if not e["chord"])


def _reference(lines: list[str], code: str) -> str | None:
    found = (re.match(rf"!!!{code}[^:]*:\s*(.+)$", x) for x in lines)
    return next((m[1].strip() for m in found if m), None)


def parse(text: str) -> dict:
    """The score of a kern text, top part first; raises Refusal."""
    lines = [x for x in re.split(r"\r?\n", text) if x]
    file = _File()
    for x in lines:
        if not x.startswith("!"):
            file.line(x)
    if file.columns is None:
        raise Refusal("no_exclusive_interpretation")
    parts = []
    for p in reversed(file.parts):
        instrument = p.instrument or "voice"
        parts.append({"instrument": instrument, "name": p.name or DISPLAY[instrument], "transpose": None, "measures": p.measures})
    remarks = [x for x in lines if x.startswith("!!")]
    return {"title": _reference(remarks, "OTL"), "composer": _reference(remarks, "COM"), "parts": parts}
