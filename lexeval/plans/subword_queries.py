"""Registered queries of the subword operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexeval.functions import text as TX
from lexeval.operators import recipes, subword
from lexeval.plans import sql_views as S
from lexeval.plans import views as V
from lexeval.plans.oracle import ORACLE
from lexeval.plans.queries import MAX_SRC, MAX_TGT, L, query, sj
from lexeval.plans.sql_views import with_views

PIECES = 1000


def _vocab(spark, sf_dir):
    return subword.piece_vocab(V.table(spark, sf_dir, "conversations", ["text"]), "text", PIECES)


def _pairs(spark, sf_dir):
    return V.translations(spark, sf_dir).transform(recipes.translation_pairs)


@query("vocab_subword")
def q_vocab_subword(spark, sf_dir):
    """Every character of the corpus and its most frequent words as pieces."""
    return _vocab(spark, sf_dir).select(F.decode("token", "UTF-8").alias("token"), L("id").alias("id"))


@query("encode_subword")
def q_encode_subword(spark, sf_dir):
    """T2 + A4 + A5 + A6: longest match over whole texts, padded labels."""
    e = subword.encode(_pairs(spark, sf_dir), _vocab(spark, sf_dir), MAX_SRC, MAX_TGT, padding="max_length")
    return e.select(L("example_id").alias("example_id"), sj(F.col("input_ids")).alias("input_ids"),
                    L(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_input"), sj(F.col("labels")).alias("labels"))


@query("decode_subword")
def q_decode_subword(spark, sf_dir):
    """T2 → T3 + T4: the ids of a text, decoded, are the text."""
    voc = _vocab(spark, sf_dir)
    e = subword.encode(_pairs(spark, sf_dir), voc, None, None)
    return subword.decode(e, "labels", voc).select(L("example_id").alias("example_id"), "text")


@query("encode_public")
def q_encode_public(spark, sf_dir):
    """T1 + T2 with the pieces of a public tokenizer's file, over whole
    documents; without SQL (brute force in the tests)."""
    import public_tokenizers

    voc = subword.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    d = V.table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumns({"input": F.col("text"), "target": F.lit("")})
    e = subword.encode(d, voc, None, None, keys=("doc_id",))
    return e.select("doc_id", L(F.size("input_ids")).alias("n_tokens"), sj(F.col("input_ids")).alias("input_ids"))


_VOCAB = [
    ("pchars", "SELECT DISTINCT unnest(string_split(text, '')) AS token FROM conversations"),
    ("pwords", f"""SELECT token, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS token FROM conversations)
                   WHERE length(token) > 1 GROUP BY token ORDER BY n DESC, token LIMIT {PIECES}"""),
    ("pieces", """SELECT token, (3 + row_number() OVER (ORDER BY kind, CASE WHEN kind = 1 THEN -n END, token))::BIGINT AS id
                  FROM (SELECT 0 AS kind, token, 0 AS n FROM pchars WHERE token <> '' UNION ALL SELECT 1, token, n FROM pwords)"""),
]

ORACLE["vocab_subword"] = with_views([], "SELECT token, id FROM pieces", extra=_VOCAB)


def _cut(name: str, text: str) -> list[tuple[str, str]]:
    """CTE ``name(example_id, ids)``: the longest piece at every position, then
    the positions that a walk from the left meets."""
    return [
        (f"{name}_t", f"SELECT example_id, {text} AS text FROM translations"),
        (f"{name}_p", f"SELECT example_id, text, unnest(range(1, length(text) + 1)) AS p FROM {name}_t"),
        (f"{name}_b", f"""SELECT example_id, p, max(l) AS l, arg_max(id, l) AS id
            FROM (SELECT example_id, p, l, substring(text, p, l) AS piece FROM {name}_p, (SELECT DISTINCT length(token) AS l FROM pieces)
                  WHERE p + l - 1 <= length(text)) JOIN pieces ON token = piece GROUP BY example_id, p"""),
        (f"{name}_l", f"SELECT example_id, list(l ORDER BY p) AS ls, list(id ORDER BY p) AS xs FROM {name}_b GROUP BY example_id"),
        (name, f"""SELECT example_id, coalesce(list_reduce(range(1, len(ls) + 1), lambda a, p: CASE WHEN a.at = p
                     THEN {{'at': p + ls[p], 'ids': list_append(a.ids, xs[p])}} ELSE a END, {{'at': 1, 'ids': []::BIGINT[]}}).ids, []) AS ids
                   FROM {name}_t LEFT JOIN {name}_l USING (example_id)"""),
    ]


ORACLE["encode_subword"] = with_views(["translations"], f"""
SELECT example_id::BIGINT AS example_id, array_to_string(list_concat(i, list_resize([]::BIGINT[], {MAX_SRC} - len(i), 0)), ' ') AS input_ids,
       len(i)::BIGINT AS n_input, array_to_string(list_concat(l, list_resize([]::BIGINT[], {MAX_TGT} - len(l), -100)), ' ') AS labels
FROM (SELECT example_id, list_append(a.ids[1:{MAX_SRC - 1}], 1) AS i, list_append(b.ids[1:{MAX_TGT - 1}], 1) AS l
      FROM src a JOIN tgt b USING (example_id))""", extra=_VOCAB + _cut("src", "translation.en") + _cut("tgt", "translation.cs"))

ORACLE["decode_subword"] = with_views(["translations"], f"""
SELECT example_id::BIGINT AS example_id, regexp_replace(translation.cs, '^{TX.WS}|{TX.WS}$', '', 'g') AS text FROM translations""")
