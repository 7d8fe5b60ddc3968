"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), with its author's later changes and the common irregular forms.

A word is a chain of consonant and vowel runs; its measure is how often a vowel run is followed by a consonant run. A `y` is a
vowel after a consonant. Each step looks for the longest of its endings and replaces it if the rest passes the ending's condition.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Forms that the steps would get wrong, and endings with what takes their place.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """The word with c for consonants and v for vowels."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in shape(word)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or not _has_vowel(rest := word[: -len(end)]):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _doubled(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short(rest) else rest


def _replaced(word: str, endings: dict[str, str]) -> str:
    end = _longest(word, endings)
    if end is None:
        return word
    rest = word[: -len(end)]
    enough = measure(rest + "l" if end == "logi" else rest) > 0
    return rest + endings[end] if enough else word


def _second(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _second(word[:-2])
    return _replaced(word, STEP_2)


def _fourth(word: str) -> str:
    end = _longest(word, STEP_4)
    if end is None:
        return word
    rest = word[: -len(end)]
    return rest if measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))) else word


def _last(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _last(_fourth(_replaced(_second(word), STEP_3)))
