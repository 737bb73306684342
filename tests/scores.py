"""Seeded random scores the model can hold: the material of round-trip tests."""

from __future__ import annotations

import random

from stavewright.functions.exact import divisions
from stavewright.functions.fixed import CLEFS, INSTRUMENTS, RATIOS, STEPS, TYPES
from stavewright.functions.schema import event


def _timing(r: random.Random):
    while True:
        kind, dots, ratio = r.choice(TYPES[:9]), r.randint(0, 2), r.choice(RATIOS) if r.random() < 1 / 7 else None
        if divisions(kind, dots, ratio):
            return kind, dots, ratio


def score(seed: int) -> dict:
    r = random.Random(seed)
    parts = []
    for _ in range(r.randint(1, 4)):
        measures = []
        for number in range(1, r.randint(1, 4) + 1):
            first = number == 1
            events = []
            for voice in range(1, r.choices([1, 2, 3], [5, 2, 1])[0] + 1):
                for i in range(r.randint(1, 6)):
                    t = _timing(r)
                    if r.random() < 0.2:
                        events.append(event("rest", *t, voice=voice))
                    else:
                        events.append(event("note", *t, step=r.choice(STEPS), alter=r.randint(-2, 2), octave=r.randint(0, 8), tie=r.choice([None, "start", "stop", "both"]), chord=i > 0 and events[-1]["kind"] == "note" and r.random() < 0.2, voice=voice))
            beats = r.randint(1, 16) if first and r.random() < 0.7 else None
            measures.append({"number": number, "key": r.randint(-7, 7) if first else None, "beats": beats, "beat_type": r.choice([1, 2, 4, 8, 16, 32]) if beats else None, "clef": r.choice(list(CLEFS)) if first else None, "events": events})
        x = r.choice(INSTRUMENTS)
        parts.append({"instrument": x[0], "name": x[1], "transpose": None, "measures": measures})
    return {"score_key": f"s{seed}", "title": None, "composer": None, "parts": parts, "error": None}
