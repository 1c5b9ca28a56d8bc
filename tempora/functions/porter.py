"""The Porter stemmer, from its published description (M. F. Porter, 1980), with the author's later departures."""

from __future__ import annotations

from functools import lru_cache

# Suffixes and what replaces them, of steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = frozenset(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))


_KIND = bytes(ord("v") if chr(i) in "aeiou" else ord("c") for i in range(256))


def _shape(w: str) -> str:
    if w.isascii() and "y" not in w:
        return w.encode().translate(_KIND).decode()
    out = ""
    for i, c in enumerate(w):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _longest(w: str, suffixes) -> str | None:
    for n in range(min(7, len(w)), 1, -1):
        if w[-n:] in suffixes:
            return w[-n:]
    return None


@lru_cache(1 << 17)
def stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, _STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
