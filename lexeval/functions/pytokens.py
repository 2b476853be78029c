"""The tokenizers of ``lexeval.functions.text`` for use inside Arrow kernels:
the same tokens from the same rules.

A kernel that needs the tokens of several families takes the text once and cuts
it here; the column expressions serve tables that keep tokens and queries of one
family.  Lower-casing stays with Spark (``lower`` there and here may know
different versions of Unicode), and so do the METEOR tokens of texts beyond
ASCII, whose classes of characters depend on that version as well.
"""

from __future__ import annotations

import re
from functools import lru_cache

from lexeval.functions.text import CHRF_PUNCT, RULES_13A, UNESCAPE_13A

_RULES = [(re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", new)) for pattern, new in RULES_13A[1:]]
_SYMBOL = re.compile(RULES_13A[0][0].replace("` -&", "`!-&"))  # padding a blank with blanks changes no token
_PUNCT = frozenset(CHRF_PUNCT)
_ROUGE = re.compile("[a-z0-9]+")
_METEOR = re.compile(r"[^\t-\r\x1c-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")


@lru_cache(1 << 14)
def _split_13a(word: str) -> tuple[str, ...]:
    """A word cut at its periods, commas and dashes.  The rules look at one
    character beside them and never use up a word's leading blank, so words are
    cut one by one as the whole text is."""
    word = f" {word} "
    for rule, new in _RULES:
        word = rule.sub(new, word)
    return tuple(word.split())


def tok_13a(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in text:
        for a, b in UNESCAPE_13A:
            text = text.replace(a, b)
    out = []
    for w in _SYMBOL.sub(r" \1 ", text).split():
        if "." in w or "," in w or "-" in w:
            out += _split_13a(w)
        else:
            out.append(w)
    return out


def chrf_chars(text: str) -> str:
    return "".join(text.split())


def chrf_words(text: str) -> list[str]:
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCT:
            out += (w[:-1], w[-1])
        elif len(w) > 1 and w[0] in _PUNCT:
            out += (w[0], w[1:])
        else:
            out.append(w)
    return out


def rouge_tokens(lowered: str) -> list[str]:
    return _ROUGE.findall(lowered)


def meteor_tokens(lowered: str) -> list[str]:
    """Of an ASCII text."""
    return _METEOR.findall(lowered)
