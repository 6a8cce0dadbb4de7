"""Indic scripts to Latin letters, in the ITRANS scheme with word-final schwas dropped.

The nine Unicode blocks from Devanagari to Malayalam share one layout, so one table by offset serves all.
"""

from __future__ import annotations

import re

FIRST, LAST, BLOCK = 0x0900, 0x0D7F, 0x80

# ITRANS letters by offset in a block.
_VOWELS = {
    0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai",
    0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au",
}
_SIGNS = {
    0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o",
    0x4A: "o", 0x4B: "o", 0x4C: "au",
}
_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "~N", 0x1A: "ch", 0x1B: "Ch", 0x1C: "j", 0x1D: "jh", 0x1E: "~n", 0x1F: "T", 0x20: "Th",
    0x21: "D", 0x22: "Dh", 0x23: "N", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b",
    0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "L", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "Sh", 0x38: "s",
    0x39: "h",
}
_OTHERS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x64: ".", 0x65: ".."}
_VIRAMA, _NUKTA = 0x4D, 0x3C
_NUKTA_FORMS = {"k": "q", "kh": "K", "g": "G", "j": "z", "ph": "f", "D": ".D", "Dh": ".Dh"}

_RUN = re.compile(r"[\u0900-\u0D7F\u200c\u200d]+")
_FINAL_SCHWA = re.compile(r"(?<=[^aeiouAEIOU\s])a\b")


def _letters(run: str) -> str:
    out, open_consonant = [], False  # open: a consonant whose inherent vowel is still to come
    for ch in run:
        if not FIRST <= ord(ch) <= LAST:
            continue
        at = (ord(ch) - FIRST) % BLOCK
        if at in _CONSONANTS:
            out.append("a" * open_consonant + _CONSONANTS[at])
            open_consonant = True
        elif at in _SIGNS:
            out.append(_SIGNS[at])
            open_consonant = False
        elif at == _VIRAMA:
            open_consonant = False
        elif at == _NUKTA and out:
            out[-1] = _NUKTA_FORMS.get(out[-1], out[-1])
        else:
            digit = str(at - 0x66) if 0x66 <= at <= 0x6F else ""
            out.append("a" * open_consonant + (_VOWELS.get(at) or _OTHERS.get(at) or digit))
            open_consonant = False
    return "".join(out) + "a" * open_consonant


def _run_to_latin(m: re.Match) -> str:
    out = _FINAL_SCHWA.sub("", _letters(m[0]))
    for a, b in (("~N", "n"), (".N", "n"), ("M", "n"), ("JN", "gy")):
        out = out.replace(a, b)
    return out


def transliterate(text: str) -> str:
    """text with every run of Indic script in Latin letters; joiners within runs are dropped."""
    return _RUN.sub(_run_to_latin, text) if text else text


_KNOWN = _VOWELS.keys() | _SIGNS.keys() | _CONSONANTS.keys() | _OTHERS.keys() | {_VIRAMA, _NUKTA} | set(range(0x66, 0x70))
#: Characters of the nine blocks that have no letters of their own here and are dropped.
UNMAPPED = "".join(chr(k) for k in range(FIRST, LAST + 1) if (k - FIRST) % BLOCK not in _KNOWN)
