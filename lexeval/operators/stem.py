"""English suffix stemming by the published rules of Porter (1980), used as the
second stage of METEOR.  A word is a run of a-z; any other token, and a word of
one or two letters, is its own stem."""

from __future__ import annotations

from functools import lru_cache

# The suffixes of each step and what replaces them.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [(s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
                            "ism", "ate", "iti", "ous", "ive", "ize")]


def shape(word: str) -> str:
    """Consonants and vowels as ``c`` and ``v``; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _ends_double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def _longest(word: str, rules: list, holds) -> str:
    """Apply the rule of the longest suffix that the word has, if its stem allows it."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found is None:
        return word
    stem = word[:len(word) - len(found[0])]
    return stem + found[1] if holds(stem, found[0]) else word


def _past_and_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        stem = word[:-len(suffix)]
        if word.endswith(suffix):
            if "v" not in shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")) or measure(stem) == 1 and _ends_cvc(stem):
                return stem + "e"
            return stem[:-1] if _ends_double(stem) and stem[-1] not in "lsz" else stem
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    word = _past_and_gerund(_longest(word, STEP_1A, lambda s, x: True))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        word = _longest(word, rules, lambda s, x: measure(s) > 0)
    word = _longest(word, STEP_4, lambda s, x: measure(s) > 1 and (x != "ion" or s.endswith(("s", "t"))))
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _ends_cvc(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stems(words) -> list[str]:
    return [stem(w) for w in words]
