"""Plain-Python word functions that the tests compare against."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def alnum_words(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def spaced_words(text):
    return SPACED.findall(text or "")
