"""English stemming by the published Porter2 algorithm (Snowball "english")."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
# The algorithm's exceptional words, and words that stay as they are.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_syllable_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.replace("\u2019", "'").lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if _has_vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, to in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi" and not w.endswith("logi"):
                    pass
                elif s == "li" and w[-3:-2] not in tuple(LI_ENDING):
                    pass
                else:
                    w = w[: -len(s)] + to
            break
    for s, to in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
