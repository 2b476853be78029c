"""Text helpers as Spark column expressions (JVM side, codegen-friendly).

Every tokenizer here returns ``array<string>`` and is built only from
built-in functions, so it runs inside the executor without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Fixed values of the public "13a" (mteval-v13a) tokenizer used by corpus BLEU.
# Entity unescapes, in the order they are applied:
UNESCAPE_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# Regex rules, applied in order (Java syntax, `$1` back-references):
#   1. pad ASCII punctuation and symbols except  ' , - .  with spaces
#   2. split period/comma preceded by a non-digit
#   3. split period/comma followed by a non-digit
#   4. split a dash preceded by a digit
RULES_13A = [
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# Punctuation split off word edges by chrF++ word n-grams (ASCII punctuation).
CHRF_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# -----------------------------------------------------------------------------

# White space as Python's ``str.split`` knows it, as the inside of a character
# class that Java and RE2 both read (their own ``\s`` is ASCII only).
WS_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CLASS}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ws(c) -> Column:
    """Split on runs of whitespace, dropping empty tokens (Python ``str.split()``)."""
    return F.filter(F.split(_c(c), WS), lambda x: x != "")


def first_words(c, n: int) -> Column:
    """:func:`split_ws` whose first ``n`` tokens are right, for a caller that cuts
    there: what lies behind them is left in one piece.  One more piece is cut than
    asked for, since white space before the first word makes an empty one."""
    return F.filter(F.split(_c(c), WS, n + 2), lambda x: x != "")


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of any kind (``str.strip()``)."""
    return F.regexp_replace(_c(c), f"^{WS}|{WS}$", "")


def normalize_13a(c) -> Column:
    s = _c(c)
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for a, b in UNESCAPE_13A:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in RULES_13A:
        s = F.regexp_replace(s, pat, rep)
    return s


def tok_13a(c, lowercase: bool = False) -> Column:
    s = _c(c)
    if lowercase:
        s = F.lower(s)
    return split_ws(normalize_13a(s))


def chrf_chars(c) -> Column:
    """Text with all whitespace removed (character n-gram input of chrF)."""
    return F.regexp_replace(_c(c), WS, "")


def chrf_words(c) -> Column:
    """Whitespace tokens with one punctuation character split off the end
    (or else off the start) of tokens longer than one character."""
    punct = F.lit(CHRF_PUNCT)

    def one(w):
        last = F.substring(w, -1, 1)
        first = F.substring(w, 1, 1)
        n = F.length(w)
        return (F.when(n == 1, F.array(w))
                .when(F.contains(punct, last), F.array(F.substring(w, 1, n - 1), last))
                .when(F.contains(punct, first), F.array(first, F.substring(w, 2, n)))
                .otherwise(F.array(w)))

    return F.flatten(F.transform(split_ws(c), one))


def rouge_tokens(c) -> Column:
    """Lower-case, non [a-z0-9] runs become separators (ROUGE default tokenizer)."""
    return split_ws(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


def ter_tokens(c, case_sensitive: bool = False) -> Column:
    s = _c(c)
    if not case_sensitive:
        s = F.lower(s)
    return split_ws(s)


def meteor_tokens(c) -> Column:
    """Lower-cased word and punctuation tokens."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(rf"[^{WS_CLASS}\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]"), 0)


def step_from_name(c) -> Column:
    """Training step from an outputs file's name or path: ``outputs_validation_1145.csv``
    and ``outputs_eval-1145.csv`` both give 1145, also as folders of part files."""
    return F.regexp_extract(_c(c), r"[-_](\d+)\.csv(?:/[^/]*)?$", 1).cast("int")


def file_suffix(c) -> Column:
    return F.substring_index(_c(c), ".", -1)


def run_key(c) -> Column:
    """Model name → run key (slashes become underscores)."""
    return F.translate(_c(c), "/", "_")
