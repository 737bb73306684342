"""Fixed values of the score model: everything here must stay as it is, in this order.

Token ids on disk depend on these lists; new entries go to the end of a list that is
marked so, never into one.
"""

from __future__ import annotations

from math import lcm

# Instruments with tokens 124..155. id|name|family|clef|lowest and highest sounding MIDI|transposition|aliases
FIRST_INSTRUMENTS = """
soprano|Soprano|voice|treble|60|81||soprn, s
alto|Alto|voice|treble|55|76||a
tenor|Tenor|voice|treble_8vb|48|69||t
bass|Bass|voice|bass|40|62||b
violin|Violin|strings|treble|55|103||violn, violino, vln, vn, violin 1, violin 2, violino 1, violino 2
viola|Viola|strings|alto|48|88||vla, va
cello|Violoncello|strings|bass|36|84||cello, violoncello, vlc, vc
contrabass|Contrabass|strings|bass|28|67|octave_down|cbass, double bass, doublebass, bass viol, cb, db
flute|Flute|woodwind|treble|60|98||flt, flauto, fl
piccolo|Piccolo|woodwind|treble|74|108|octave_up|picco, flauto piccolo, picc
oboe|Oboe|woodwind|treble|58|93||ob
english_horn|English Horn|woodwind|treble|45|81|perfect_fifth_down|cor anglais, corno inglese, englishhorn, eh
clarinet|Clarinet|woodwind|treble|50|94|major_second_down|clars, clarinetto, cl, bb clarinet, clarinet in bb, clarinet in b flat, soprano clarinet
bass_clarinet|Bass Clarinet|woodwind|treble|34|75|major_ninth_down|clarinetto basso, bcl, bass clarinet in bb
bassoon|Bassoon|woodwind|bass|34|75||fagot, fagotto, bsn, bn
contrabassoon|Contrabassoon|woodwind|bass|22|63|octave_down|contrafagotto, double bassoon, cbsn
horn|Horn|brass|treble|35|77|perfect_fifth_down|cor, corno, french horn, hn, horn in f, f horn
trumpet|Trumpet|brass|treble|52|84|major_second_down|tromp, tromba, tpt, tp, bb trumpet, trumpet in bb
trombone|Trombone|brass|bass|40|77||tromb, trombono, tbn, tb
bass_trombone|Bass Trombone|brass|bass|34|70||btbn
tuba|Tuba|brass|bass|26|65||tba
timpani|Timpani|percussion|bass|36|60||timpa, timp, kettledrums
harp|Harp|keyboard|treble|23|103||arpa, hp
piano|Piano|keyboard|treble|21|108||pianoforte, pno, pf
organ|Organ|keyboard|treble|24|96||orgue, org
harpsichord|Harpsichord|keyboard|treble|29|89||cemba, cembalo, clavecin, hpschd
guitar|Guitar|strings|treble_8vb|40|83|octave_down|guitr, chitarra, gtr
recorder|Recorder|woodwind|treble|72|105||recor, blockflote, rec
voice|Voice|voice|treble||||vox, vocal
mezzo_soprano|Mezzo-soprano|voice|treble|57|79||mezzo, ms
baritone|Baritone|voice|bass|45|65||barit, bar
percussion|Percussion|percussion|treble||||perc, drums
"""

# Instruments with tokens from 535 on.
LATER_INSTRUMENTS = """
clarinet_c|Clarinet in C|woodwind|treble|52|96||c clarinet
clarinet_a|Clarinet in A|woodwind|treble|49|93|minor_third_down|a clarinet, clarinet in a
clarinet_d|Clarinet in D|woodwind|treble|54|98|major_second_up|d clarinet
clarinet_eb|Clarinet in E♭|woodwind|treble|55|99|minor_third_up|eb clarinet, clarinet in eb, sopranino clarinet
clarinet_ab|Clarinet in A♭|woodwind|treble|60|104|minor_sixth_up|ab clarinet, clarinet in ab, piccolo clarinet
contra_alto_clarinet|Contra-alto Clarinet in E♭|woodwind|treble|27|68|major_thirteenth_down|eb contra alto clarinet, contralto clarinet
contrabass_clarinet|Contrabass Clarinet in B♭|woodwind|treble|22|63|two_octaves_major_second_down|bb contrabass clarinet
basset_horn|Basset Horn in F|woodwind|treble|41|77|perfect_fifth_down|corno di bassetto
sopranino_sax|Sopranino Saxophone in E♭|woodwind|treble|61|92|minor_third_up|sopranino saxophone, eb sopranino sax
soprano_sax|Soprano Saxophone in B♭|woodwind|treble|56|88|major_second_down|soprano saxophone, bb soprano sax, sop sax
alto_sax|Alto Saxophone in E♭|woodwind|treble|49|80|major_sixth_down|alto saxophone, eb alto sax, alto sax, asax
tenor_sax|Tenor Saxophone in B♭|woodwind|treble|44|76|major_ninth_down|tenor saxophone, bb tenor sax, tenor sax, tsax
baritone_sax|Baritone Saxophone in E♭|woodwind|treble|36|68|major_thirteenth_down|baritone saxophone, eb baritone sax, bari sax
bass_sax|Bass Saxophone in B♭|woodwind|treble|32|63|two_octaves_major_second_down|bass saxophone, bb bass sax
alto_flute|Alto Flute in G|woodwind|treble|55|93|perfect_fourth_down|g alto flute, flauto contralto
bass_flute|Bass Flute|woodwind|treble|48|86|octave_down|flauto basso
oboe_damore|Oboe d'amore in A|woodwind|treble|55|89|minor_third_down|oboe damore, oboe d amore
horn_eb|Horn in E♭|brass|treble|34|76|major_sixth_down|eb horn
trumpet_c|Trumpet in C|brass|treble|54|86||c trumpet
trumpet_d|Trumpet in D|brass|treble|56|88|major_second_up|d trumpet
trumpet_eb|Trumpet in E♭|brass|treble|57|89|minor_third_up|eb trumpet
cornet|Cornet in B♭|brass|treble|52|84|major_second_down|bb cornet, cornetto
flugelhorn|Flugelhorn in B♭|brass|treble|50|82|major_second_down|bb flugelhorn, flugel horn
euphonium|Euphonium|brass|bass|34|70||euph
treble_flute|Treble Flute in G|woodwind|treble|||perfect_fifth_up|g treble flute
soprano_flute|Soprano Flute in E♭|woodwind|treble|||minor_third_up|eb soprano flute
contra_alto_flute|Contra-alto Flute in G|woodwind|bass|||octave_perfect_fourth_down|g contra alto flute
contrabass_flute|Contrabass Flute|woodwind|bass|||two_octaves_down|cbass flute
bass_guitar|Bass Guitar|strings|bass|28|67|octave_down|electric bass, bass gtr, ebass
electric_guitar|Electric Guitar|strings|treble_8vb|40|88|octave_down|egtr, elec guitar
mandolin|Mandolin|strings|treble|55|96||mand, mandolino
banjo|Banjo|strings|treble||||bjo
trumpet_a|Trumpet in A|brass|treble|||minor_third_down|a trumpet
trumpet_f|Trumpet in F|brass|treble|||perfect_fourth_up|f trumpet
piccolo_trumpet_bb|Piccolo Trumpet in B♭|brass|treble|||minor_seventh_up|bb piccolo trumpet
piccolo_trumpet_a|Piccolo Trumpet in A|brass|treble|||major_sixth_up|a piccolo trumpet
bass_trumpet_bb|Bass Trumpet in B♭|brass|treble|||major_ninth_down|bb bass trumpet
bass_trumpet_c|Bass Trumpet in C|brass|treble|||octave_down|c bass trumpet
cornet_eb|Cornet in E♭|brass|treble|||minor_third_up|eb cornet, soprano cornet
alto_horn|Alto Horn in E♭|brass|treble|||major_sixth_down|tenor horn, eb alto horn, eb tenor horn
mellophone|Mellophone in F|brass|treble|||perfect_fifth_down|f mellophone
baritone_horn|Baritone Horn in B♭|brass|treble|34|70|major_ninth_down|bb baritone horn, baritone treble
euphonium_bb|Euphonium in B♭|brass|treble|34|70|major_ninth_down|bb euphonium, euphonium treble
wagner_tuba_bb|Wagner Tuba in B♭|brass|treble|||major_second_down|bb wagner tuba
wagner_tuba_f|Wagner Tuba in F|brass|treble|||perfect_fifth_down|f wagner tuba
alto_trombone|Alto Trombone|brass|alto||||atbn
contrabass_trombone|Contrabass Trombone|brass|bass||||cbtbn
cimbasso|Cimbasso|brass|bass||||
sousaphone|Sousaphone|brass|bass|26|65||sousa
horn_bb_alto|Horn in B♭ alto|brass|treble|||major_second_down|bb horn alto, corno bb alto
horn_bb_basso|Horn in B♭ basso|brass|treble|||major_ninth_down|bb horn basso, corno bb basso
horn_a|Horn in A|brass|treble|||minor_third_down|a horn
horn_g|Horn in G|brass|treble|||perfect_fourth_down|g horn
horn_e|Horn in E|brass|treble|||minor_sixth_down|e horn
horn_d|Horn in D|brass|treble|||minor_seventh_down|d horn
c_melody_sax|C Melody Saxophone|woodwind|treble||||c melody sax, c tenor sax
xylophone|Xylophone|percussion|treble|77|108|octave_up|xyl
glockenspiel|Glockenspiel|percussion|treble|79|108|two_octaves_up|glock, orchestra bells
celesta|Celesta|keyboard|treble|60|108|octave_up|celeste
vibraphone|Vibraphone|percussion|treble|53|89||vibes, vibraharp, vib
marimba|Marimba|percussion|treble|36|96||mba
tubular_bells|Tubular Bells|percussion|treble||||chimes
drum_set|Drum Set|percussion|treble||||drum kit, drumset, trap set
electric_piano|Electric Piano|keyboard|treble|28|103||rhodes, epiano, wurlitzer
accordion|Accordion|keyboard|treble||||squeezebox
harmonica|Harmonica|woodwind|treble|60|96||mouth organ, chromatic harmonica
"""

INSTRUMENT_COLUMNS = ("instrument", "name", "family", "clef", "low_midi", "high_midi", "transposition", "aliases")


def _entry(line: str) -> tuple:
    i, name, family, clef, low, high, transposition, aliases = line.split("|")
    return i, name, family, clef, int(low) if low else None, int(high) if high else None, transposition or None, aliases.split(", ") if aliases else []


FIRST = [_entry(x) for x in FIRST_INSTRUMENTS.split("\n") if x]
LATER = [_entry(x) for x in LATER_INSTRUMENTS.split("\n") if x]
INSTRUMENTS = FIRST + LATER

# Steps in letter order, their semitone above C, their place on the line of fifths.
STEPS = ["C", "D", "E", "F", "G", "A", "B"]
SEMITONES = [0, 2, 4, 5, 7, 9, 11]
FIFTHS = [0, 2, 4, -1, 1, 3, 5]

# Interval name to (letters, semitones).
INTERVALS = {
    "unison": (0, 0), "minor_second": (1, 1), "major_second": (1, 2), "minor_third": (2, 3), "major_third": (2, 4), "perfect_fourth": (3, 5), "perfect_fifth": (4, 7),
    "minor_sixth": (5, 8), "major_sixth": (5, 9), "minor_seventh": (6, 10), "major_seventh": (6, 11), "octave": (7, 12),
}
# Short names of simple intervals.
QUALITIES = {
    (0, 0): "P1", (0, 1): "A1", (1, 1): "m2", (1, 2): "M2", (2, 3): "m3", (2, 4): "M3", (3, 5): "P4", (3, 6): "A4", (4, 6): "d5", (4, 7): "P5", (5, 8): "m6", (5, 9): "M6", (6, 10): "m7", (6, 11): "M7",
}


def _transposition(name: str) -> tuple[int, int]:
    """"major_ninth_down" and the like, as (letters, semitones): an interval, whole octaves, a direction."""
    words = name.removesuffix("_down").removesuffix("_up")
    octaves, base = 0, words
    for prefix, n in (("two_octaves", 2), ("octave", 1)):
        if words.startswith(prefix):
            octaves, base = n, words[len(prefix) :].strip("_") or "unison"
            break
    compound = {"major_ninth": "major_second", "major_thirteenth": "major_sixth"}
    if base in compound:
        octaves, base = octaves + 1, compound[base]
    d, c = INTERVALS[base]
    sign = -1 if name.endswith("_down") else 1
    return sign * (d + 7 * octaves), sign * (c + 12 * octaves)


TRANSPOSITIONS = {x[6]: _transposition(x[6]) for x in INSTRUMENTS if x[6]}

# Tuplet counts that divide a beat exactly, and the ratios that may be written, by age.
TUPLET_ACTUALS = [3, 5, 7, 9, 11, 13, 15]
CANONICAL_RATIOS = [(3, 2), (5, 4), (7, 4), (9, 8), (11, 8), (13, 8), (15, 8)]
EXTENDED_RATIOS = [(2, 1), (2, 3), (4, 3), (4, 6), (5, 2), (5, 3), (6, 4), (7, 1), (7, 8)]
LATER_RATIOS = [(7, 6), (8, 2), (9, 4), (10, 4), (10, 8), (11, 12), (12, 8), (16, 8), (22, 16), (35, 16)]
RATIOS = CANONICAL_RATIOS + EXTENDED_RATIOS + LATER_RATIOS

#: Divisions of a quarter: 512 times the least number all tuplet counts divide.
DIVISIONS = 512 * lcm(*TUPLET_ACTUALS)
# Written durations in token order, each with its length as a power of two of a quarter.
TYPES = ["breve", "whole", "half", "quarter", "eighth", "16th", "32nd", "64th", "128th", "256th", "long"]
POWERS = [3, 2, 1, 0, -1, -2, -3, -4, -5, -6, 4]
BASE = {t: DIVISIONS * 2**p if p >= 0 else DIVISIONS // 2**-p for t, p in zip(TYPES, POWERS)}
MAX_DOTS = 4

# Clefs in token order with sign, line and octave change.
CLEFS = {
    "treble": ("G", 2, 0), "bass": ("F", 4, 0), "alto": ("C", 3, 0), "tenor": ("C", 4, 0), "treble_8vb": ("G", 2, -1), "soprano": ("C", 1, 0), "mezzo_soprano": ("C", 2, 0),
    "baritone": ("F", 3, 0), "treble_8va": ("G", 2, 1), "treble_15ma": ("G", 2, 2), "bass_8vb": ("F", 4, -1), "bass_8va": ("F", 4, 1), "french_violin": ("G", 1, 0),
}
# Clefs as kern writes them.
KERN_CLEFS = {"G2": "treble", "Gv2": "treble_8vb", "G^2": "treble_8va", "G1": "french_violin", "F4": "bass", "Fv4": "bass_8vb", "F3": "baritone", "C1": "soprano", "C2": "mezzo_soprano", "C3": "alto", "C4": "tenor"}

MAX_PARTS, MAX_VOICES = 32, 8


def plain_durations() -> dict[int, tuple[str, int]]:
    """Divisions of every duration without tuplet that comes out whole, to (type, dots)."""
    out = {}
    for t in TYPES:
        for dots in range(MAX_DOTS + 1):
            n, rest = divmod(BASE[t] * (2 ** (dots + 1) - 1), 2**dots)
            if not rest:
                out.setdefault(n, (t, dots))
    return out


def vocabulary() -> list[str]:
    """Every token; its place is its id. Blocks are only ever appended."""
    old, late = TYPES[:8], TYPES[8:9]
    blocks = [
        ["pad", "bos", "eos", "measure", "chord", "tie_start", "tie_stop", "rest"],
        [f"key:{k}" for k in range(-7, 8)],
        [f"time:{n}:{d}" for n in range(1, 17) for d in (1, 2, 4, 8, 16, 32)],
        [f"clef:{c}" for c in list(CLEFS)[:5]],
        [f"instrument:{x[0]}" for x in FIRST],
        [f"part:{p}" for p in range(MAX_PARTS)],
        [f"pitch:{s}:{a}:{o}" for o in range(9) for s in STEPS for a in range(-2, 3)],
        [f"dur:{t}:{d}" for t in old for d in range(3)],
        [f"voice:{v}" for v in range(1, MAX_VOICES + 1)],
        [f"instrument:{x[0]}" for x in LATER],
        [f"tuplet:{a}:{n}" for a, n in CANONICAL_RATIOS[:4]],
        [f"dur:{t}:3" for t in old],
        [f"tuplet:{a}:{n}" for a, n in CANONICAL_RATIOS[4:]],
        [f"dur:{t}:{d}" for t in late for d in range(4)],
        [f"tuplet:{a}:{n}" for a, n in EXTENDED_RATIOS],
        [f"dur:{t}:4" for t in old + late],
        [f"tuplet:{a}:{n}" for a, n in LATER_RATIOS],
        [f"dur:{t}:{d}" for t in TYPES[9:] for d in range(MAX_DOTS + 1)],
        [f"clef:{c}" for c in list(CLEFS)[5:]],
    ]
    return [token for block in blocks for token in block]
