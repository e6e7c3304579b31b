"""Character tables for text that looks alike: built by rule from the Unicode database, and one list of look-alike letters."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

# Look-alike letters of other scripts, each with the letter it stands for.
LATIN_LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "т": "t", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "г": "r", "п": "n", "ү": "y",
    "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "σ": "o", "ό": "ó", "ά": "á", "έ": "é", "ί": "í",
    # Armenian, Cherokee
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Ս": "U", "Օ": "O", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Letters of other alphabets in Arabic script, each with the Arabic letter it looks like.
ARABIC_LOOKALIKES = {"ک": "ك", "ڪ": "ك", "ی": "ي", "ې": "ي", "ہ": "ه", "ھ": "ه", "ە": "ه", "ۀ": "ه", "ے": "ي", "ٱ": "ا", "ۃ": "ة"}
# Proper words of other languages in Arabic script (names of languages), and letters that only those languages have.
PERSIAN_WORDS = ["فارسی", "کردی", "کوردی", "دری", "اردو"]
PERSIAN_ONLY = "پچژگٹڈڑںۆێ"
#: Spaces other than the plain one.
SPACES = "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")
_TAGS = {"font", "wide", "narrow", "compat", "initial", "medial", "final", "isolated", "circle", "square"}


def _categories() -> list[tuple[str, str, str]]:
    return [(c, unicodedata.category(c), unicodedata.decomposition(c)) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xAC00 <= ord(c) <= 0xD7A3 and not 0x4E00 <= ord(c) <= 0x9FFF]


@cache
def tables() -> dict[str, object]:
    """styled: a letter or digit in another form -> plain form; marks: other compatibility forms (full-width signs) -> plain; invisible: characters that show nothing."""
    styled, marks, invisible = {}, {}, []
    for c, cat, dec in _categories():
        plain = unicodedata.normalize("NFKC", c)
        if cat == "Cf" and not 0x0600 <= ord(c) <= 0x06DD and ord(c) != 0x08E2 or cat == "Cc" and ord(c) != 0x85 or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in "͏ᅟᅠ឴឵ㅤﾠ":
            invisible.append(c)
        elif plain == c:
            continue
        elif dec.startswith("<"):
            tag = dec[1 : dec.index(">")]
            if tag in _TAGS and (cat[0] == "L" or cat in ("Nd", "No", "Nl", "So")) and (all(x.isalnum() or unicodedata.category(x) == "Mn" for x in plain)) and not 0x3000 <= ord(c) <= 0x9FFF:
                styled[c] = plain
            elif tag in ("wide", "narrow"):
                marks[c] = plain
        elif cat[0] == "L" and len(unicodedata.normalize("NFD", c)) == 1:
            styled[c] = plain  # another code for the same letter (kelvin, angstrom, ohm sign)
    return {"styled": styled, "marks": marks, "invisible": invisible}


def char_class(chars) -> str:
    """A regular-expression class of these characters, as ranges (for RE2 and for ``re``)."""
    points = sorted({ord(c) for c in chars})
    spans: list[list[int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    esc = lambda p: f"\\x{{{p:04x}}}"
    return "[" + "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in spans) + "]"


@cache
def _plain_tables() -> tuple[dict, frozenset, frozenset, re.Pattern, dict, dict]:
    t = tables()
    fold = {ord(k): v for k, v in {**t["styled"], **t["marks"]}.items()} | {ord(c): None for c in t["invisible"]} | {ord(c): " " for c in SPACES}
    spans = ((0x370, 0x400), (0x400, 0x530), (0x530, 0x590), (0x13A0, 0x1400))
    script = frozenset(map(chr, (p for a, b in spans for p in range(a, b)))) | frozenset(ARABIC_LOOKALIKES)
    marks = map(chr, [*range(0x300, 0x370), 0x653, 0x654, 0x655])
    return fold, script | frozenset(map(chr, fold)) | frozenset(marks), script, re.compile(r"[^\W_]+"), str.maketrans(LATIN_LOOKALIKES), str.maketrans(ARABIC_LOOKALIKES)


def canonical(text: str) -> str:
    """The one form of a text, in plain Python: the same rules as the operator in ``normal``, for operators that compare words. Keeps line breaks."""
    if text.isascii():
        return text
    fold, any_odd, odd, word, latin, arabic = _plain_tables()
    if any_odd.isdisjoint(text):
        return text

    def fix(m: re.Match) -> str:
        w = m.group()
        if odd.isdisjoint(w):
            return w
        if not ARABIC_LOOKALIKES.keys().isdisjoint(w):
            return w if w in PERSIAN_WORDS or any(c in PERSIAN_ONLY for c in w) else w.translate(arabic)
        return w.translate(latin) if any(c < "\u0250" and c.isalpha() for c in w) or all(c in LATIN_LOOKALIKES for c in w if c.isalpha()) and len(w) < 3 else w

    def line(x: str) -> str:
        if any_odd.isdisjoint(x):
            return x
        x = unicodedata.normalize("NFC", x.translate(fold))
        return x if odd.isdisjoint(x) else word.sub(fix, x)

    return "\n".join(map(line, text.split("\n")))


_CLUSTER = re.compile("(?s).[\u0300-\u036f\u0653-\u0655]*")


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The canonical form and, for each of its characters and the end, the place in the text it comes from; None where nothing was changed."""
    plain = canonical(text)
    if plain == text:
        return plain, None
    fold = _plain_tables()[0]
    offsets: list[int] = []
    for m in _CLUSTER.finditer(text):
        offsets += [m.start()] * len(unicodedata.normalize("NFC", m.group().translate(fold)))
    if len(offsets) != len(plain):  # marks that compose in another order: the unchanged runs on both sides tell the places
        from difflib import SequenceMatcher

        offsets = [0] * len(plain)
        for tag, a, b, x, y in SequenceMatcher(None, text, plain, autojunk=False).get_opcodes():
            for k in range(x, y):
                offsets[k] = a + (k - x if tag == "equal" else min(k - x, max(0, b - a - 1)))
    return plain, [*offsets, len(text)]
