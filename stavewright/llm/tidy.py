"""The one consistent form of text: characters that look the same become the same."""

from __future__ import annotations

import re
import sys
import unicodedata

# Fixed values. Characters that show nothing: soft hyphen, joiners, zero-width spaces, fillers, marks, embeddings and
# isolates of direction, variation selectors, invisible operators, annotation, shorthand and musical controls. Not the
# tags after a flag, which say what flag it is.
_INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0100, 0xE01EF),
]
INVISIBLE = "".join(chr(c) for low, high in _INVISIBLE for c in range(low, high + 1))
# Spaces of any width that separate words as an ordinary one does; not those that end a line.
SPACES = "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")
# Cyrillic, Greek, Armenian and phonetic letters, and the Latin ones they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЁЇЀӒӦаеѕіјорсухһԁԛԝёїѐӓӧ"
CYRILLIC_AS = "ABESIJKMHOPCTYXËÏÈÄÖaesijopcyxhdqwëïèäö"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΪΫϹͿοϲϳνρυόύϋαγικάίϊ"
GREEK_AS = "ABEZHIKMNOPTYXÏŸCJocjvpuóúüayikáíï"
OTHER = "ӏӀօսհոɑɡı"
OTHER_AS = "lIouhnagi"
# Full-width and half-width forms and what they stand for. Voiced marks of half-width kana compose with what is before.
_WIDTHS = {chr(c): chr(int(d[1], 16)) for c in range(0xFF01, 0xFFEF) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and chr(c) not in INVISIBLE}
FULL, FULL_AS = "".join(_WIDTHS), "".join(_WIDTHS.values())
VOICED = "\uff9e\uff9f"

FROM = SPACES + CYRILLIC + GREEK + OTHER + FULL
TO = " " * len(SPACES) + CYRILLIC_AS + GREEK_AS + OTHER_AS + FULL_AS

_BASE = str.maketrans(FROM, TO)


def _compatible() -> dict[str, str]:
    """What other compatibility forms stand for, by Unicode's own decompositions: styles of a letter, ligatures, letters that double as signs.

    Forms that look different stay: superscripts, circled and squared characters, fractions, an ellipsis. So do single jamo, which would join into syllables.
    """
    out = {}
    for c in map(chr, [*range(0x80, 0x3131), *range(0x3190, 0x4E00), *range(0xF900, 0x10000), *range(0x1D400, 0x1FC00)]):  # where there are any
        kind = unicodedata.decomposition(c).split(">")[0]
        plain = unicodedata.normalize("NFKC", c)
        if kind in ("<font", "<compat", "<noBreak", "<small") and c not in FROM and c not in INVISIBLE and (len(plain) == 1 and not unicodedata.category(plain)[0] in "ZM" or len(plain) > 1 and plain.isalpha()):
            out[c] = plain.translate(_BASE)
    return out


_COMPATIBLE = _compatible()
SINGLE = {c: x for c, x in _COMPATIBLE.items() if len(x) == 1}
LIGATURES = {c: x for c, x in _COMPATIBLE.items() if len(x) > 1}


def _ranges(chars) -> str:
    """The inside of a character class. Ranges, because beyond the basic plane each single character is one more comparison."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


_MAP = {chr(c): chr(x) for c, x in _BASE.items()} | _COMPATIBLE
_HIDDEN = frozenset(INVISIBLE)
_SPECIAL = _HIDDEN | _MAP.keys()


def tidy(text: str) -> str:
    """Invisible characters out, accents composed, look-alikes replaced, composed again."""
    # A text has few different characters, however long: they are looked up, not its places.
    if text.isascii() or (_SPECIAL.isdisjoint(seen := set(text)) and unicodedata.is_normalized("NFC", text)):
        return text
    for c in seen & _HIDDEN:
        text = text.replace(c, "")
    text = unicodedata.normalize("NFC", text)
    for c in set(text) & _MAP.keys():  # what they become is never mapped itself
        text = text.replace(c, _MAP[c])
    return unicodedata.normalize("NFC", text)


def pieces(text: str) -> list[tuple[int, int]]:
    """[start, end) of each base character with the marks and invisible characters after it: what tidying treats alone."""
    starts = [i for i, c in enumerate(text) if i == 0 or not (c in _HIDDEN or c in VOICED or unicodedata.category(c)[0] == "M")]
    return list(zip(starts, [*starts[1:], len(text)]))


def _unsettled() -> list[str]:
    """Characters whose presence means that a text may not be in normal form C: those that never are, and those that may join what is before."""
    return [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M" or "\u1161" <= c <= "\u11ff" or not unicodedata.is_normalized("NFC", c)]


def tidy_sql(column: str) -> str:
    """The same steps in DuckDB's SQL. A text without any character that they could touch is left as it is."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = f"nfc_normalize(regexp_replace({column}, '[{_ranges(INVISIBLE)}]', '', 'g'))"
    split = plain
    for c, x in LIGATURES.items():
        split = f"replace({split}, {quote(c)}, {quote(x)})"
    split = f"CASE WHEN regexp_matches({column}, '[{_ranges(LIGATURES)}]') THEN {split} ELSE {plain} END"
    mapped = (
        f"CASE WHEN regexp_matches({column}, '[{_ranges(_COMPATIBLE)}]') THEN translate({split}, {quote(FROM + ''.join(SINGLE))}, {quote(TO + ''.join(SINGLE.values()))})"
        f" ELSE translate({plain}, {quote(FROM)}, {quote(TO)}) END"
    )
    return f"CASE WHEN regexp_matches({column}, '[{_ranges({*_SPECIAL, *_unsettled()})}]') THEN nfc_normalize({mapped}) ELSE {column} END"
