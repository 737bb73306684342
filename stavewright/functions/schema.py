"""The shapes scores take: nested, one row a score, at the boundaries; long tables in between."""

from __future__ import annotations

EVENT = "struct<kind:string,step:string,alter:int,octave:int,dur_type:string,dots:int,tie:string,chord:boolean,voice:int,actual:int,normal:int>"
MEASURE = f"struct<number:int,key:int,beats:int,beat_type:int,clef:string,events:array<{EVENT}>>"
PART = f"struct<instrument:string,name:string,transpose:struct<diatonic:int,chromatic:int>,measures:array<{MEASURE}>>"
REFUSAL = "struct<code:string,detail:string>"
#: One row a parsed file: a score, or the reason why not.
SCORE = f"score_key string, title string, composer string, parts array<{PART}>, error {REFUSAL}"


class Refusal(Exception):
    """Music the model can't hold: a result, not a crash. ``where`` says in which measure."""

    def __init__(self, code: str, detail: object = None):
        super().__init__(code, detail)
        self.code, self.detail = code, None if detail is None else str(detail)


def event(kind: str, dur_type: str, dots: int, ratio: tuple[int, int] | None, **more) -> dict:
    """A note or rest with all fields of EVENT."""
    actual, normal = ratio or (None, None)
    base = {"kind": kind, "step": None, "alter": None, "octave": None, "dur_type": dur_type, "dots": dots, "tie": None, "chord": False, "voice": 1, "actual": actual, "normal": normal}
    return base | more
