"""Vocabulary, encoding, padding/masking, batching and decoding of id
sequences, as DataFrame operations.

The pretrained subword tokenizer of a model is a per-row library and is not
rebuilt here; instead a word vocabulary is *learned from the corpus* (T1) and
every table-level step around a tokenizer is a Spark job: lookup (T2),
truncation (A4), padding and attention masks (A5), label masking (A6), dynamic
per-batch padding (A7), decoder inputs (A8), decoding (T3), strip (T4),
generated length (T5) and language-code ids (T7).

Lookups have one plan for a vocabulary of any size: tokens leave their row with
its number and their place, meet the vocabulary in a join, and are gathered
again by row number, so rows may share ids.  No job runs while a query is
built.  A vocabulary cut to its ``k`` has a known bound and is broadcast below
the size limit; then the tokens of a row meet again in the task they came from
and the shuffle moves one array a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexeval.functions.text import first_words, split_ws, strip_ws
from lexeval.operators.sizing import DEFAULT_BROADCAST_BYTES, estimated_bytes, spread

# --- fixed values -----------------------------------------------------------
# Reserved ids, in id order, before the learned vocabulary.
SPECIALS = ["<pad>", "</s>", "<unk>", "<s>"]
PAD_ID, EOS_ID, UNK_ID, BOS_ID = 0, 1, 2, 3
LABEL_IGNORE_ID = -100
# Language codes per multilingual model family: (source, target).
LANG_CODES = {
    "m2m100": ("en", "cs"),
    "nllb": ("eng_Latn", "ces_Latn"),
    "mbart": ("en_XX", "cs_CZ"),
}
# -----------------------------------------------------------------------------

def lang_token(family: str, code: str) -> str:
    """Vocabulary token of a language code (m2m100 wraps codes in double
    underscores; the other families use the code itself)."""
    return f"__{code}__" if family == "m2m100" else code


def lang_tokens() -> list[str]:
    """Language-code tokens appended after the learned vocabulary, in family order."""
    out: list[str] = []
    for fam, (src, tgt) in LANG_CODES.items():
        for code in (src, tgt):
            t = lang_token(fam, code)
            if t not in out:
                out.append(t)
    return out


def fixed_tokens(spark, rows: list[tuple[str, int]]) -> DataFrame:
    """``(token, id)`` of a few given rows.  Made of literals, so that the plan
    knows their size; a table of local rows has none, and a vocabulary that held
    one would never be broadcast."""
    each = [F.struct(F.lit(t).alias("token"), F.lit(i).cast("int").alias("id")) for t, i in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*each)))


# T1
def build_vocab(texts: DataFrame, col: str = "text", k: int = 500, tokenizer=split_ws) -> DataFrame:
    """``(token, id)``: the specials, then the ``k`` most frequent tokens (count
    desc, token asc), then language-code tokens.  Counting is a partial
    (map-side) aggregation, so very frequent tokens do not skew the shuffle;
    only the top-k rows reach a single task."""
    counts = texts.select(F.explode(tokenizer(col)).alias("token")).groupBy("token").count()
    # a corpus word that equals a reserved token must not get a second id
    counts = counts.where(~F.col("token").isin(SPECIALS + lang_tokens()))
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(k)
    spark = texts.sparkSession
    specials = fixed_tokens(spark, [(t, i) for i, t in enumerate(SPECIALS)])
    # row_number over the ≤ k rows of the top-k result only
    ranked = top.select("token", (F.row_number().over(Window.orderBy(F.desc("count"), F.asc("token")))
                                  + len(SPECIALS) - 1).cast("int").alias("id"))
    langs = fixed_tokens(spark, [(t, i + len(SPECIALS) + k) for i, t in enumerate(lang_tokens())])
    return specials.unionByName(ranked).unionByName(langs)


# J3
def items(*arrays: Column) -> Column:
    """Elements of arrays as ``array<struct<c,p,t>>``: array number, place, value."""
    def placed(c):
        return lambda t, i: F.struct(F.lit(c).alias("c"), i.alias("p"), t.alias("t"))
    return F.concat(*[F.transform(a, placed(c)) for c, a in enumerate(arrays)])


def lookup(df: DataFrame, keys, found: Column, table: DataFrame, key: str, value: str, words: bool = False) -> DataFrame:
    """``(keys..., found)``: for each row the :func:`items` with the ``value``
    that ``table`` has for them as ``v`` (NULL where it has none; the smallest
    of several), in order.  Rows without items stay.  The items' own values
    travel back with them as ``t`` if ``words``."""
    known = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_t")).agg(F.min(value).alias("_v"))
    if estimated_bytes(table) is not None and estimated_bytes(table) <= DEFAULT_BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = df.select(*keys, F.monotonically_increasing_id().alias("_row"), found.alias("_items"))
    each = rows.select(*keys, "_row", F.explode_outer("_items").alias("_x"))
    each = each.withColumn("_t", F.col("_x.t")).join(known, "_t", "left")
    one = F.struct(F.col("_x.c").alias("c"), F.col("_x.p").alias("p"), *([F.col("_t").alias("t")] if words else []), F.col("_v").alias("v"))
    out = each.groupBy("_row").agg(*[F.any_value(k).alias(k) for k in keys],
                                   F.sort_array(F.collect_list(F.when(F.col("_x").isNotNull(), one))).alias("found"))
    return out.select(*keys, "found")


def values(found: Column, array: int, default: Column | None = None) -> Column:
    """The looked-up values of one of the arrays, in order."""
    of = lambda x: x["v"] if default is None else F.coalesce(x["v"], default)
    return F.transform(F.filter(found, lambda x: x["c"] == array), of)


# A4 / A5 / A6 / T2
def truncate(ids: Column, max_length: int | None) -> Column:
    """Keep room for the end-of-sequence id, then append it; no limit: all ids."""
    return F.concat(ids if max_length is None else F.slice(ids, 1, max_length - 1), F.array(F.lit(EOS_ID)))


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def pad_to(ids: Column, length, pad_id: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(_lit(length) - F.size(ids), F.lit(0))))


def mask_of(ids: Column, length) -> Column:
    n = F.size(ids)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(_lit(length) - n, F.lit(0))))


def encode(df: DataFrame, vocab: DataFrame, max_source_length: int | None = 1024, max_target_length: int | None = 128,
           padding: str | bool = False, ignore_pad_token_for_loss: bool = True, keys=("example_id",),
           tokenizer=split_ws, target_vocab: DataFrame | None = None, target_tokenizer=None) -> DataFrame:
    """``input → input_ids, attention_mask``; ``target → labels``; every other
    column is dropped except ``keys`` (and ``split``, if there is one).  Rows
    are encoded one by one, so ids may repeat.  ``padding="max_length"`` pads to
    the max lengths; then label pads become -100 if
    ``ignore_pad_token_for_loss``.  Tokens beyond a max length, which cannot
    reach the result, are not looked up.  Targets use their own vocabulary and
    tokenizer where given."""
    keys = list(keys) + [c for c in ("split",) if c in df.columns and c not in keys]

    def tokens(col, split, limit):
        text = F.coalesce(F.col(col), F.lit(""))
        if limit is None:
            return split(text)
        return F.slice(first_words(text, limit - 1) if split is split_ws else split(text), 1, limit - 1)

    source, target = tokens("input", tokenizer, max_source_length), tokens("target", target_tokenizer or tokenizer, max_target_length)
    vocab = vocab.select("token", "id")
    if target_vocab is None:
        both = lookup(spread(df), keys, items(source, target), vocab, "token", "id")
        parts = (values(F.col("found"), 0, F.lit(UNK_ID)), values(F.col("found"), 1, F.lit(UNK_ID)))
    else:  # a token of each side has its own vocabulary
        sides = vocab.select(F.struct(F.lit(0).alias("c"), "token").alias("token"), "id").union(
            target_vocab.select(F.struct(F.lit(1).alias("c"), "token").alias("token"), "id"))
        marked = [F.transform(source, lambda t: F.struct(F.lit(0).alias("c"), t.alias("token"))),
                  F.transform(target, lambda t: F.struct(F.lit(1).alias("c"), t.alias("token")))]
        both = lookup(spread(df), keys, items(*marked), sides, "token", "id")
        parts = (values(F.col("found"), 0, F.lit(UNK_ID)), values(F.col("found"), 1, F.lit(UNK_ID)))
    out = both.select(*keys, truncate(parts[0], max_source_length).alias("ids"), truncate(parts[1], max_target_length).alias("lab"))
    if padding == "max_length":
        if max_source_length is None or max_target_length is None:
            raise ValueError("padding to the max length needs both lengths")
        labels = pad_to(F.col("lab"), max_target_length)
        if ignore_pad_token_for_loss:
            labels = F.transform(labels, lambda x: F.when(x == PAD_ID, F.lit(LABEL_IGNORE_ID)).otherwise(x))
        return out.select(*keys, pad_to(F.col("ids"), max_source_length).alias("input_ids"),
                          mask_of(F.col("ids"), max_source_length).alias("attention_mask"),
                          labels.alias("labels"))
    return out.select(*keys, F.col("ids").alias("input_ids"),
                      F.array_repeat(F.lit(1), F.size("ids")).alias("attention_mask"),
                      F.col("lab").alias("labels"))


# A7
def collate(encoded: DataFrame, batch_col: str = "batch_id", pad_to_multiple_of: int | None = None,
            label_pad_id: int = LABEL_IGNORE_ID) -> DataFrame:
    """Dynamic padding: every row is padded to the longest row of its batch
    (rounded up to a multiple when asked).  One shuffle on the batch id; a
    batch is small by definition."""
    w = Window.partitionBy(batch_col)
    width = lambda c: F.max(F.size(c)).over(w)
    up = lambda n: (F.ceil(n / pad_to_multiple_of) * pad_to_multiple_of).cast("int") if pad_to_multiple_of else n
    j = encoded.withColumns({"w_in": up(width("input_ids")), "w_lab": up(width("labels"))})
    return j.select(
        *[c for c in encoded.columns if c not in ("input_ids", "attention_mask", "labels")],
        pad_to(F.col("input_ids"), F.col("w_in")).alias("input_ids"),
        pad_to(F.col("attention_mask"), F.col("w_in"), 0).alias("attention_mask"),
        pad_to(F.col("labels"), F.col("w_lab"), label_pad_id).alias("labels"))


# A8
def decoder_inputs(labels: Column, start_id: int = EOS_ID, pad_id: int = PAD_ID) -> Column:
    """Labels shifted right behind the start id; ignored positions become pad."""
    shifted = F.concat(F.array(F.lit(start_id)), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.transform(shifted, lambda x: F.when(x == LABEL_IGNORE_ID, F.lit(pad_id)).otherwise(x))


# T3 / T4
def decode(df: DataFrame, col: str, vocab: DataFrame, keys=("example_id",), out: str = "text", skip_special: bool = True,
           carry: dict[str, Column] | None = None) -> DataFrame:
    """``(keys..., out)``: ids back to text, ignored and (if asked) reserved ids
    left out, stripped.  ``carry`` adds small columns computed from the row."""
    special = F.array(*[F.lit(i) for i in range(len(SPECIALS))])
    keep = F.filter(F.col(col), lambda x: (x != LABEL_IGNORE_ID) & (~F.array_contains(special, x) if skip_special else F.lit(True)))
    rows = df.select(*keys, keep.alias("_ids"), *[c.alias(n) for n, c in (carry or {}).items()])
    found = lookup(rows, [*keys, *(carry or {})], items(F.col("_ids")), vocab.select("id", "token"), "id", "token")
    text = strip_ws(F.array_join(values(F.col("found"), 0, F.lit(SPECIALS[UNK_ID])), " "))
    return found.select(*keys, *(carry or {}), text.alias(out))


# T5
def gen_len(ids: Column, pad_id: int = PAD_ID) -> Column:
    """Per-row generated length: ids other than pad (specials count)."""
    return F.size(F.filter(ids, lambda x: x != pad_id))


# T6
def first_of_tuple(df: DataFrame, col: str) -> DataFrame:
    """Tuple predictions (a struct of arrays): keep the first element."""
    dt = df.schema[col].dataType
    if dt.typeName() == "struct":
        return df.withColumn(col, F.col(col)[dt.fields[0].name])
    return df


# T7
def lang_table(spark, vocab: DataFrame) -> DataFrame:
    """``(family, src_lang, tgt_lang, tgt_lang_id)``; fixed three-row table,
    ids resolved against the vocabulary."""
    fams = spark.createDataFrame([(f, lang_token(f, s), lang_token(f, t)) for f, (s, t) in LANG_CODES.items()],
                                 "family string, src_lang string, tgt_lang string")
    return fams.join(vocab.select(F.col("token").alias("tgt_lang"), F.col("id").alias("tgt_lang_id")), "tgt_lang")


def force_target_language(df: DataFrame, langs: DataFrame, family_col: str = "family",
                          col: str = "labels") -> DataFrame:
    """Prefix the target-language id (the forced first generated id, which is
    also the decoder start id when the model has none)."""
    j = df.join(langs.select(F.col("family").alias(family_col), "tgt_lang_id"), family_col)
    return j.withColumn(col, F.concat(F.array("tgt_lang_id"), F.col(col)))
