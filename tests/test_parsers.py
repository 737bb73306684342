import zipfile
from io import BytesIO

import pytest

from stavewright.functions.fixed import DIVISIONS
from stavewright.functions.schema import Refusal
from stavewright.operators.musicxml import brackets, document
from stavewright.sources import kern, musicxml


def k(*lines):
    return "\n".join("\t".join(x) if isinstance(x, tuple) else x for x in lines)


def notes(part, measure=0):
    return [(e["kind"], e["step"], e["octave"], e["dur_type"], e["dots"], e["voice"]) for e in part["measures"][measure]["events"]]


def test_kern_parts_are_reversed_and_attributes_kept():
    s = kern.parse(k("!!!COM: Somebody", "!!!OTL@EN: A title ", ("**kern", "**dynam", "**kern"), ('*I"Bass', "*", "*Ivioln"), ("*clefF4", "*", "*clefG2"), ("*k[b-e-]", "*", "*k[]"), ("*M3/4", "*", "*MM120"), ("4C", "f", "[4.cc# 8ee"), ("4r", ".", "4cc]"), ("=", "=", "="), ("*-", "*-", "*-")))
    assert (s["title"], s["composer"]) == ("A title", "Somebody")
    top, low = s["parts"]
    assert (top["instrument"], low["instrument"], low["name"]) == ("violin", "bass", "Bass")
    assert top["measures"][0]["key"] == 0 and low["measures"][0]["key"] == -2 and low["measures"][0]["beats"] == 3 and top["measures"][0]["beats"] is None
    first, second, third = top["measures"][0]["events"]
    assert (first["tie"], first["alter"], first["octave"], first["dots"]) == ("start", 1, 5, 1) and second["chord"] and third["tie"] == "stop"
    assert len(low["measures"]) == 1  # an empty measure is none


def test_kern_splits_and_late_voices():
    s = kern.parse(k("**kern", "4c", "*^", ("4d", "4e"), ("*v", "*v"), "=", "4f", "*-"))
    assert notes(s["parts"][0]) == [("note", "C", 4, "quarter", 0, 1), ("note", "D", 4, "quarter", 0, 1), ("rest", None, None, "quarter", 0, 2), ("note", "E", 4, "quarter", 0, 2)]
    assert len(s["parts"][0]["measures"]) == 2


@pytest.mark.parametrize("token, expected", [("12c", ("eighth", 0, 3, 2)), ("24c", ("16th", 0, 3, 2)), ("6c", ("quarter", 0, 3, 2)), ("40c", ("32nd", 0, 5, 4)), ("112c", ("64th", 0, 7, 4)), ("72c", ("64th", 0, 9, 8)), ("12.c", ("eighth", 1, 3, 2)), ("0c", ("breve", 0, None, None)), ("00c", ("long", 0, None, None)), ("0000c", ("breve", 0, None, None)), ("3%2c", ("half", 0, 3, 2)), ("4yy", ("quarter", 0, None, None))])
def test_kern_durations(token, expected):
    e = kern.parse(k("**kern", token, "*-"))["parts"][0]["measures"][0]["events"][0]
    assert (e["dur_type"], e["dots"], e["actual"], e["normal"]) == expected


@pytest.mark.parametrize("lines, code", [(["4c"], "no_exclusive_interpretation"), ([("**dynam",), "f"], "unsupported_spines"), (["**kern", "*x"], "unsupported"), (["**kern", "*+"], "unsupported"), (["**kern", "17c"], "unsupported_tuplet"), (["**kern", "256c"], "unsupported_duration"), (["**kern", "000c"], "unsupported_duration"), (["**kern", "c"], "missing_duration"), (["**kern", "4"], "missing_pitch"), (["**kern", "4.....c"], "unrepresentable_duration")])
def test_kern_refusals(lines, code):
    with pytest.raises(Refusal) as e:
        kern.parse(k(*lines))
    assert e.value.code == code


def test_kern_grace_notes_barlines_and_too_many_voices():
    s = kern.parse(k("**kern", "8qc", "4d", "=:|!", "4e", "=", "=", "*-"))
    assert [m["number"] for m in s["parts"][0]["measures"]] == [1, 2]
    with pytest.raises(Refusal, match="unsupported"):
        kern.parse(k("**kern", *[tuple(["*^"] + ["*"] * i) for i in range(9)]))


def doc(measure, divisions=16, name="Flute"):
    return f'<score-partwise><part-list><score-part id="P1"><part-name>{name}</part-name></score-part></part-list><part id="P1"><measure number="1"><attributes><divisions>{divisions}</divisions></attributes>{measure}</measure></part></score-partwise>'


def note(step, length, kind=None, voice=None, more=""):
    return f"<note>{more}<pitch><step>{step}</step><octave>4</octave></pitch><duration>{length}</duration>" + (f"<voice>{voice}</voice>" if voice else "") + (f"<type>{kind}</type>" if kind else "") + "</note>"


def back(n):
    return f"<backup><duration>{n}</duration></backup>"


def forward(n):
    return f"<forward><duration>{n}</duration></forward>"


def test_xml_voices_and_gaps():
    s = musicxml.parse(doc(note("C", 16, "quarter", 5) + back(16) + note("E", 16, "quarter", 1) + note("D", 16, "quarter", 5)))
    assert [(e["step"], e["voice"]) for e in s["parts"][0]["measures"][0]["events"]] == [("C", 1), ("D", 1), ("E", 2)]
    s = musicxml.parse(doc(note("C", 16, "quarter") + forward(16) + note("D", 16, "quarter")))
    assert notes(s["parts"][0])[1][0] == "rest" and s["parts"][0]["instrument"] == "flute"
    s = musicxml.parse(doc(note("C", 12, "quarter") + forward(4) + note("D", 12, "quarter"), divisions=12))
    assert [(e["kind"], e["actual"]) for e in s["parts"][0]["measures"][0]["events"]] == [("note", None), ("rest", 3), ("note", None)]
    s = musicxml.parse(doc(note("C", 16, "quarter") + note("E", 16, "quarter", more="<chord/>") + "<note><grace/><pitch><step>A</step><octave>4</octave></pitch></note>"))
    assert [e["chord"] for e in s["parts"][0]["measures"][0]["events"]] == [False, True]


@pytest.mark.parametrize("measure, code", [(note("C", 32, "half") + back(16) + note("D", 16, "quarter"), "overlapping_voice"), (note("H", 16, "quarter"), "bad_step"), (note("C", 16, "1024th"), "unsupported_type"), ("<note><rest/></note>", "missing_duration_element"), ("<note><unpitched/><duration>16</duration></note>", "unpitched_note"), (note("C", 5), "unnotatable_duration"), ("<attributes><time><beats>4(2)</beats></time></attributes>", "bad_time"), ("<attributes><clef><sign>percussion</sign></clef></attributes>", "unsupported_clef"), ("<note>", "other")])
def test_xml_refusals(measure, code):
    with pytest.raises(Refusal) as e:
        musicxml.parse(doc(measure))
    assert e.value.code == code


def test_xml_unrepresentable_offset():
    with pytest.raises(Refusal) as e:
        musicxml.parse(doc(note("C", 17, "quarter") + forward(5) + note("D", 17, "quarter"), divisions=17))
    assert e.value.code == "unrepresentable_offset"


def test_unzip():
    def zipped(**files):
        b = BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for name, text in files.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
        return b.getvalue()

    assert musicxml.unzip(zipped(**{"META-INF__container_xml": "no", "score_xml": "yes"}), "k") == b"yes"
    for content, code in ((zipped(**{"META-INF__container_xml": "no"}), "mxl_no_score_member"), (b"nonsense", "mxl_unzip_failed")):
        with pytest.raises(Refusal) as e:
            musicxml.unzip(content, "k")
        assert e.value.code == code


def test_written_scores_read_back():
    text = k("!!!OTL: A & B <c>", "**kern", "*clefG2", "*k[f#]", "*M4/4", "[4c", "12d", "12e", "12f", "4.g]", "8r", "=", "*^", ("4c 4e", "2g"), ("4d", "."), ("*v", "*v"), "*-")
    s = kern.parse(text)
    xml = document(s["title"], s["composer"], s["parts"])
    again = musicxml.parse(xml)
    assert again["title"] == "A & B <c>" and again["parts"] == s["parts"]
    assert f"<divisions>{DIVISIONS}</divisions>" in xml and xml.count('<tuplet type="start"/>') == 1


def test_brackets():
    e = {"dur_type": "eighth", "dots": 0, "actual": 3, "normal": 2, "chord": False}
    plain = e | {"actual": None, "normal": None}
    assert brackets([e] * 6) == ["start", None, "stop"] * 2
    assert brackets([e, plain, e, e]) == ["both", None, "start", "stop"]
    assert brackets([e, e | {"chord": True}, e, e]) == ["start", None, None, "stop"]
