"""DuckDB SQL twins of the registered queries (independent re-statement of
each operator's semantics over the same base tables)."""

from __future__ import annotations

from lexeval.plans import sql_views as S
from lexeval.plans.sql_views import with_views

ORACLE: dict[str, str] = {}


def _bleu_sql(lower: bool, name: str, orders: int = 4) -> str:
    each = lambda form, sep: sep.join(form.format(n) for n in range(1, orders + 1))
    grams_h = " UNION ALL ".join(
        f"SELECT step, example_id, hyp_len, ref_len, {n} AS n, -1 AS src, unnest({S.ngrams('hyp', n)}) AS gram FROM q"
        for n in range(1, 5))
    grams_r = " UNION ALL ".join(
        f"SELECT step, example_id, hyp_len, ref_len, {n} AS n, k AS src, unnest({S.ngrams('r', n)}) AS gram FROM qr"
        for n in range(1, 5))
    body = f"""
SELECT step, round(CASE WHEN NOT ({each("m{} > 0", " OR ")}) OR {each("t{} = 0", " OR ")}
                   THEN 0.0
                   ELSE bp * exp(({each("ln(p{})", " + ")}) / {orders}) END, 6) AS {name}
FROM (
  SELECT *,
    CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END AS bp,
    CASE WHEN m1 > 0 THEN 100.0 * m1 / t1 ELSE 100.0 / (2 ^ z1 * t1) END AS p1,
    CASE WHEN m2 > 0 THEN 100.0 * m2 / t2 ELSE 100.0 / (2 ^ z2 * t2) END AS p2,
    CASE WHEN m3 > 0 THEN 100.0 * m3 / t3 ELSE 100.0 / (2 ^ z3 * t3) END AS p3,
    CASE WHEN m4 > 0 THEN 100.0 * m4 / t4 ELSE 100.0 / (2 ^ z4 * t4) END AS p4
  FROM (
    SELECT *, (m1 = 0)::INT AS z1, (m1 = 0)::INT + (m2 = 0)::INT AS z2,
           (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT AS z3,
           (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT + (m4 = 0)::INT AS z4
    FROM (
      SELECT step, sum(hyp_len)::DOUBLE AS sys_len, sum(ref_len)::DOUBLE AS ref_len,
             sum(m1) AS m1, sum(m2) AS m2, sum(m3) AS m3, sum(m4) AS m4,
             sum(greatest(hyp_len, 0)) AS t1, sum(greatest(hyp_len - 1, 0)) AS t2,
             sum(greatest(hyp_len - 2, 0)) AS t3, sum(greatest(hyp_len - 3, 0)) AS t4
      FROM (
        SELECT q.step, q.example_id, q.hyp_len, q.ref_len,
               coalesce(sum(CASE WHEN n = 1 THEN mm END), 0) AS m1, coalesce(sum(CASE WHEN n = 2 THEN mm END), 0) AS m2,
               coalesce(sum(CASE WHEN n = 3 THEN mm END), 0) AS m3, coalesce(sum(CASE WHEN n = 4 THEN mm END), 0) AS m4
        FROM q LEFT JOIN (
          SELECT step, example_id, n, gram, least(coalesce(max(CASE WHEN src < 0 THEN c END), 0),
                                                  coalesce(max(CASE WHEN src >= 0 THEN c END), 0)) AS mm
          FROM (SELECT step, example_id, n, gram, src, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL
        ) x USING (step, example_id)
        GROUP BY ALL)
      GROUP BY step)))"""
    return with_views(["eval_pairs"], body, extra=[
        ("p", f"""SELECT step, example_id, {S.tok13a('prediction', lower)} AS hyp,
                  list_transform({S.usable_refs()}, lambda r: {S.tok13a('r', lower)}) AS refs FROM eval_pairs
                  WHERE len({S.usable_refs()}) > 0"""),
        ("q", """SELECT step, example_id, hyp, refs, len(hyp) AS hyp_len,
                 coalesce(list_sort(list_transform(refs, lambda r: {'d': abs(len(r) - len(hyp)), 'l': len(r)}))[1].l, 0)
                   AS ref_len FROM p"""),
        ("qr", "SELECT step, example_id, hyp_len, ref_len, unnest(refs) AS r, generate_subscripts(refs, 1) - 1 AS k FROM q"),
        ("g", f"{grams_h} UNION ALL {grams_r}"),
    ])


ORACLE["bleu"] = _bleu_sql(False, "bleu")
ORACLE["bleu_lower"] = _bleu_sql(True, "bleu_lower")


def _chrf_f(beta: int) -> str:
    return f"CASE WHEN p + rr > 0 THEN 100.0 * {1 + beta * beta} * p * rr / ({beta * beta} * p + rr) ELSE 0.0 END"


def _chrf_cte(words: int = 2, beta: int = 2) -> list[tuple[str, str]]:
    """Per (step, example_id): best-reference chrF++ statistics."""
    hyp_items = " UNION ALL ".join(
        [f"SELECT step, example_id, {n} AS o, -1 AS src, unnest({S.char_ngrams('hc', n)}) AS gram FROM cp"
         for n in range(1, 7)]
        + [f"SELECT step, example_id, {6 + n} AS o, -1 AS src, unnest({S.ngrams('hw', n)}) AS gram FROM cp"
           for n in range(1, 3)])
    ref_items = " UNION ALL ".join(
        [f"SELECT step, example_id, {n} AS o, k AS src, unnest({S.char_ngrams('rc', n)}) AS gram FROM cr"
         for n in range(1, 7)]
        + [f"SELECT step, example_id, {6 + n} AS o, k AS src, unnest({S.ngrams('rw', n)}) AS gram FROM cr"
           for n in range(1, 3)])
    return [
        ("cp", f"""SELECT step, example_id, {S.chrf_chars('prediction')} AS hc, {S.chrf_words('prediction')} AS hw,
                   {S.usable_refs()} AS refs FROM eval_pairs"""),
        ("cr0", """SELECT step, example_id, unnest(refs) AS r, generate_subscripts(refs, 1) - 1 AS k FROM cp"""),
        ("cr", f"""SELECT step, example_id, k, {S.chrf_chars('r')} AS rc, {S.chrf_words('r')} AS rw FROM cr0"""),
        ("items", f"{hyp_items} UNION ALL {ref_items}"),
        ("c1", "SELECT step, example_id, o, gram, src, count(*) AS c FROM items GROUP BY ALL"),
        ("hyp_tot", "SELECT step, example_id, o, sum(c) AS h FROM c1 WHERE src = -1 GROUP BY ALL"),
        ("ref_m", """SELECT r.step, r.example_id, r.src AS k, r.o, sum(r.c) AS r, sum(least(r.c, coalesce(h.c, 0))) AS m
                     FROM (SELECT * FROM c1 WHERE src >= 0) r
                     LEFT JOIN (SELECT * FROM c1 WHERE src = -1) h USING (step, example_id, o, gram)
                     GROUP BY ALL"""),
        ("cells", f"""SELECT cr0.step, cr0.example_id, cr0.k, o.o,
                       coalesce(ht.h, 0) AS h, coalesce(rm.r, 0) AS r, coalesce(rm.m, 0) AS m
                     FROM cr0 CROSS JOIN (SELECT unnest(range(1, {7 + words})) AS o) o
                     LEFT JOIN hyp_tot ht ON ht.step = cr0.step AND ht.example_id = cr0.example_id AND ht.o = o.o
                     LEFT JOIN ref_m rm ON rm.step = cr0.step AND rm.example_id = cr0.example_id
                                        AND rm.k = cr0.k AND rm.o = o.o"""),
        ("fk", """SELECT step, example_id, k,
                   sum(CASE WHEN h > 0 AND r > 0 THEN 1 ELSE 0 END) AS eff,
                   sum(CASE WHEN h > 0 AND r > 0 THEN m / h ELSE 0.0 END) AS sp,
                   sum(CASE WHEN h > 0 AND r > 0 THEN m / r ELSE 0.0 END) AS sr
                  FROM cells GROUP BY ALL"""),
        ("fk2", """SELECT step, example_id, k,
                    CASE WHEN eff > 0 THEN sp / eff ELSE 0.0 END AS p, CASE WHEN eff > 0 THEN sr / eff ELSE 0.0 END AS rr
                   FROM fk"""),
        ("fsent", f"SELECT step, example_id, k, {_chrf_f(beta)} AS f FROM fk2"),
        ("best", """SELECT step, example_id, k AS best_ref, f AS chrf FROM (
                      SELECT *, row_number() OVER (PARTITION BY step, example_id ORDER BY round(f, 9) DESC, k) AS rn FROM fsent)
                    WHERE rn = 1"""),
    ]


ORACLE["chrf_per_example"] = with_views(
    ["eval_pairs"], """SELECT step, example_id, best_ref, round(chrf, 6) AS chrf
FROM eval_pairs LEFT JOIN best USING (step, example_id)""", extra=_chrf_cte())

def _chrf_sql(name: str, words: int = 2, beta: int = 2) -> str:
    return with_views(["eval_pairs"], f"""
SELECT step, round({_chrf_f(beta)}, 6) AS {name}
FROM (SELECT step, CASE WHEN eff > 0 THEN sp / eff ELSE 0.0 END AS p, CASE WHEN eff > 0 THEN sr / eff ELSE 0.0 END AS rr
      FROM (SELECT step, sum(CASE WHEN h > 0 AND r > 0 THEN 1 ELSE 0 END) AS eff,
                   sum(CASE WHEN h > 0 AND r > 0 THEN m / h ELSE 0.0 END) AS sp,
                   sum(CASE WHEN h > 0 AND r > 0 THEN m / r ELSE 0.0 END) AS sr
            FROM (SELECT c.step, c.o, sum(c.h) AS h, sum(c.r) AS r, sum(c.m) AS m
                  FROM cells c JOIN best b ON b.step = c.step AND b.example_id = c.example_id AND b.best_ref = c.k
                  GROUP BY ALL)
            GROUP BY step))""", extra=_chrf_cte(words, beta))


ORACLE["chrf_pp"] = _chrf_sql("chrf_pp")


# ============================================================ sources / recipes
SEP = " ||| "

ORACLE["dataset_split"] = with_views(["splits"], """
SELECT example_id::BIGINT AS example_id, split, input, lang FROM splits WHERE split = 'validation'""")

ORACLE["subset_head"] = with_views(["splits"], """
SELECT example_id::BIGINT AS example_id, split FROM (
  SELECT example_id, split, row_number() OVER (PARTITION BY split ORDER BY example_id) AS rn FROM splits)
WHERE (split = 'train' AND rn <= 50) OR (split = 'validation' AND rn <= 10) OR split = 'test'""")

ORACLE["dialogue_pairs"] = with_views(["dialogue_acts"], """
SELECT example_id::BIGINT AS example_id, split, da AS input, text AS target FROM dialogue_acts""")

ORACLE["translation_pairs"] = with_views(["translations"], """
SELECT example_id::BIGINT AS example_id, split, translation.en AS input, translation.cs AS target,
       translation.cs AS translation_cs FROM translations""")

ORACLE["lex_filter"] = with_views(["ref_filtered"], f"""
SELECT example_id::BIGINT AS example_id, len(lex)::BIGINT AS n_refs, array_to_string(lex, '{SEP}') AS refs_text
FROM ref_filtered""")

ORACLE["linearise_triples"] = with_views(["triple_sets"], """
SELECT example_id::BIGINT AS example_id, array_to_string(modified_triple_sets.mtriple_set[1], ' - ') AS input
FROM triple_sets""")

_LIN = "array_to_string(modified_triple_sets.mtriple_set[1], ' - ')"

ORACLE["multi_reference"] = with_views(["ref_filtered"], f"""
SELECT example_id::BIGINT AS example_id, split, {_LIN} AS input, len(lex)::BIGINT AS n_refs,
       array_to_string(lex, '{SEP}') AS refs_text FROM ref_filtered""")

ORACLE["flatten_first"] = with_views(["ref_filtered"], f"""
SELECT example_id::BIGINT AS example_id, {_LIN} AS input, lex[1] AS target FROM ref_filtered WHERE len(lex) > 0""")

ORACLE["flatten_all"] = with_views(["ref_filtered"], f"""
SELECT example_id::BIGINT AS example_id, {_LIN} AS input, unnest(lex) AS target FROM ref_filtered""")

ORACLE["flatten_by_split"] = with_views(["ref_filtered"], f"""
SELECT example_id::BIGINT AS example_id, split, {_LIN} AS input,
       unnest(CASE WHEN split = 'train' THEN lex ELSE lex[1:1] END) AS target FROM ref_filtered""")

# ============================================================ alignment / arrays
ORACLE["flatten_references"] = with_views(["eval_refs"], """
SELECT example_id::BIGINT AS example_id, source, (generate_subscripts("references", 1) - 1)::BIGINT AS ref_idx,
       unnest("references") AS reference FROM eval_refs""")

ORACLE["pad_references"] = with_views(["eval_refs"], f"""
SELECT example_id::BIGINT AS example_id, m::BIGINT AS n_refs,
       array_to_string(list_concat("references", list_transform(range(m - len("references")), lambda i: '')),
                       '{SEP}') AS refs_text
FROM eval_refs, (SELECT max(len("references")) AS m FROM eval_refs)""")

ORACLE["max_references"] = with_views(["eval_refs"], """
SELECT max(len("references"))::BIGINT AS max_references FROM eval_refs""")

ORACLE["best_per_owner"] = with_views(["ref_groups", "scored_refs"], """
SELECT g.example_id::BIGINT AS example_id, round(b.best_score, 6) AS best_score
FROM ref_groups g LEFT JOIN (SELECT example_id, max(score) AS best_score FROM scored_refs GROUP BY example_id) b
  USING (example_id)""")

ORACLE["external_score"] = with_views(["ref_groups", "scored_refs"], """
SELECT round(avg(b.best_score), 6) AS score
FROM ref_groups g LEFT JOIN (SELECT example_id, max(score) AS best_score FROM scored_refs GROUP BY example_id) b
  USING (example_id)""")

ORACLE["align_examples"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, prediction, source,
       len("references")::BIGINT AS n_refs FROM eval_pairs""")

ORACLE["alignment_report"] = with_views(["ref_groups"], f"""
SELECT coalesce(i.example_id, o.example_id)::BIGINT AS example_id, i.input AS expected, o.source AS got
FROM (SELECT example_id, {_LIN} AS input FROM ref_groups) i
FULL OUTER JOIN (
  SELECT example_id, CASE WHEN example_id % 7 = 3 THEN input || ' (edited)' ELSE input END AS source
  FROM (SELECT example_id, {_LIN} AS input FROM ref_groups) WHERE example_id % 11 <> 5) o
  ON i.example_id = o.example_id
WHERE i.input IS DISTINCT FROM o.source""")

ORACLE["dedup_recent"] = with_views(["dedup_stream"], """
SELECT s.run::BIGINT AS run, s.prediction::BIGINT AS prediction, s.source
FROM s JOIN r ON r.run = s.run AND r.k = s.k WHERE r.kept""", extra=[
    ("s", "SELECT run, source, prediction, row_number() OVER (PARTITION BY run ORDER BY pos) AS k FROM dedup_stream"),
    ("r", """SELECT run, k, true AS kept, [source] AS last3 FROM s WHERE k = 1
             UNION ALL
             SELECT s.run, s.k, NOT list_contains(r.last3, s.source),
                    CASE WHEN list_contains(r.last3, s.source) THEN r.last3
                         ELSE list_append(r.last3, s.source)[-3:] END
             FROM r JOIN s ON s.run = r.run AND s.k = r.k + 1"""),
]).replace("WITH ", "WITH RECURSIVE ", 1)

# ============================================================ metrics
_ED = """list_reduce(a, lambda prev, x: list_reduce(range(1, len(b) + 1),
           lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[j] + 1,
                                                 prev[j] + CASE WHEN x = b[j] THEN 0 ELSE 1 END)), [prev[1] + 1]),
         range(len(b) + 1))[-1]"""
_LCS = """list_reduce(a, lambda prev, x: list_reduce(range(1, len(b) + 1),
            lambda cur, j: list_append(cur, CASE WHEN x = b[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END),
            [0]), list_transform(range(len(b) + 1), lambda i: 0))[-1]"""

#: Edits over the references and their mean length, of each example with references.
EDIT_EACH = """
SELECT step, example_id, min(CASE WHEN len(b) = 0 THEN len(a) ELSE d END) AS e, avg(len(b)) AS rl
FROM (SELECT *, """ + _ED + """ AS d FROM (
        SELECT step, example_id, """ + S.words("lower(prediction)") + """ AS a,
               """ + S.words("lower(r)") + """ AS b
        FROM (SELECT step, example_id, prediction, unnest(""" + S.usable_refs() + """) AS r FROM eval_pairs)))
GROUP BY ALL"""

WORD_EDIT_RATE = f"""
SELECT step::BIGINT AS step,
       round(CASE WHEN sum(rl) > 0 THEN 100.0 * sum(e) / sum(rl) WHEN sum(e) > 0 THEN 100.0 ELSE 0.0 END, 6)
         AS word_edit_rate
FROM ({EDIT_EACH})
GROUP BY step"""

ORACLE["word_edit_rate"] = with_views(["eval_pairs"], WORD_EDIT_RATE)

#: ROUGE-L F1 of the best reference, of each example with references.
ROUGE_EACH = """
SELECT step, example_id, max(CASE WHEN la > 0 AND lb > 0 AND l > 0 THEN 2.0 * (l / la) * (l / lb) / (l / la + l / lb)
                                 ELSE 0.0 END) AS f
FROM (SELECT *, len(a) AS lb, len(b) AS la, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE """ + _LCS + """ END AS l
      FROM (SELECT step, example_id, """ + S.rouge_tokens("r") + """ AS a, """ + S.rouge_tokens("prediction") + """ AS b
            FROM (SELECT step, example_id, prediction,
                         unnest(""" + S.usable_refs() + """) AS r FROM eval_pairs)))
GROUP BY ALL"""

ORACLE["rouge_l"] = with_views(["eval_pairs"], f"""
SELECT step::BIGINT AS step, round(avg(f), 6) AS rougeL FROM ({ROUGE_EACH}) GROUP BY step""")

_MTOK = "regexp_extract_all(lower({x}), '[^" + S.WS_CLASS.replace("{", "{{").replace("}", "}}") + "\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]')"


def _meteor_ctes():
    return [
        ("mr", """SELECT step, example_id, prediction, unnest(""" + S.usable_refs() + """) AS rt,
                         generate_subscripts(""" + S.usable_refs() + """, 1) AS k
                  FROM eval_pairs"""),
        ("mr2", f"""SELECT step, example_id, k, {_MTOK.format(x='prediction')} AS h, {_MTOK.format(x='rt')} AS r
                   FROM mr"""),
        ("ht", "SELECT step, example_id, k, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM mr2"),
        ("rt_", "SELECT step, example_id, k, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM mr2"),
        ("hr", "SELECT *, row_number() OVER (PARTITION BY step, example_id, k, w ORDER BY i DESC) AS q FROM ht"),
        ("rr", "SELECT *, row_number() OVER (PARTITION BY step, example_id, k, w ORDER BY j DESC) AS q FROM rt_"),
        ("mm", "SELECT hr.step, hr.example_id, hr.k, hr.i, rr.j FROM hr JOIN rr USING (step, example_id, k, w, q)"),
        ("ch", """SELECT step, example_id, k, count(*) AS m,
                         1 + sum(CASE WHEN pi IS NULL OR (i = pi + 1 AND j = pj + 1) THEN 0 ELSE 1 END) AS chunks
                  FROM (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM mm
                        WINDOW w AS (PARTITION BY step, example_id, k ORDER BY i))
                  GROUP BY ALL"""),
        ("msc", """SELECT mr2.step, mr2.example_id, mr2.k,
                          CASE WHEN coalesce(ch.m, 0) = 0 THEN 0.0 ELSE
                            (1 - 0.5 * pow(ch.chunks / ch.m, 3)) *
                            ((ch.m / len(mr2.h)) * (ch.m / len(mr2.r)) /
                             (0.9 * (ch.m / len(mr2.h)) + 0.1 * (ch.m / len(mr2.r)))) END AS s
                   FROM mr2 LEFT JOIN ch USING (step, example_id, k)"""),
        ("mex", "SELECT step, example_id, max(s) AS meteor FROM msc GROUP BY ALL"),
    ]


ORACLE["meteor"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, round(avg(meteor), 6) AS meteor FROM mex GROUP BY step""", extra=_meteor_ctes())

ORACLE["meteor_per_example"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, round(meteor, 6) AS meteor
FROM eval_pairs LEFT JOIN mex USING (step, example_id)""",
                                          extra=_meteor_ctes())

_EMB = [
    ("tv", """SELECT example_id, side, coalesce(ref_idx, -1) AS ref_idx, tok,
                     list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding,
                         lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM token_vectors"""),
    ("sim", """SELECT c.example_id, r.ref_idx, c.tok AS ct, r.tok AS rt,
                      list_sum(list_transform(range(1, len(c.u) + 1), lambda i: c.u[i] * r.u[i])) AS s
               FROM tv c JOIN tv r ON c.example_id = r.example_id AND c.side = 'cand' AND r.side = 'ref'"""),
    ("pp", """SELECT example_id, ref_idx, avg(m) AS p FROM (
                SELECT example_id, ref_idx, ct, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL"""),
    ("rr2", """SELECT example_id, ref_idx, avg(m) AS r FROM (
                SELECT example_id, ref_idx, rt, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL"""),
    ("prf", """SELECT example_id, max(p) AS emb_precision, max(r) AS emb_recall,
                      max(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS emb_f1
               FROM pp JOIN rr2 USING (example_id, ref_idx) GROUP BY example_id"""),
]

ORACLE["embedding_match"] = with_views(["token_vectors"], """
SELECT round(avg(emb_precision), 5) AS emb_precision, round(avg(emb_recall), 5) AS emb_recall,
       round(avg(emb_f1), 5) AS emb_f1 FROM prf""", extra=_EMB)

ORACLE["embedding_per_example"] = with_views(["token_vectors"], """
SELECT example_id::BIGINT AS example_id, round(emb_precision, 5) AS emb_precision, round(emb_recall, 5) AS emb_recall,
       round(emb_f1, 5) AS emb_f1 FROM prf""", extra=_EMB)

# ============================================================ reports
ORACLE["gen_len"] = with_views(["eval_preds"], f"""
SELECT step::BIGINT AS step, round(avg(len({S.words('prediction')}) + 1), 6) AS gen_len
FROM eval_preds GROUP BY step""")

_SUMMARY_COLS = [("BLEU", "bleu"), ("BLEU_lower", "bleu_lower"), ("chrF++", "chrf_pp"), ("rougeL", "rouge_l"),
                 ("meteor", "meteor"), ("gen_len", "gen_len")]
_SUMMARY_SRC = {"bleu": "bleu", "bleu_lower": "bleu_lower", "chrf_pp": "chrf_pp", "rouge_l": "rougeL",
                "meteor": "meteor", "gen_len": "gen_len"}


def _summary_sql() -> str:
    parts = []
    for i, (out, q) in enumerate(_SUMMARY_COLS):
        parts.append(f"(SELECT step, {_SUMMARY_SRC[q]} AS v{i} FROM ({ORACLE[q]})) t{i}")
    sel = ", ".join(f't{i}.v{i} AS "{out}"' for i, (out, _) in enumerate(_SUMMARY_COLS))
    joins = parts[0] + "".join(f" JOIN {p} USING (step)" for p in parts[1:])
    return f"SELECT step::BIGINT AS step, {sel} FROM {joins}"


ORACLE["summary_wide"] = _summary_sql()
ORACLE["metric_log"] = ("SELECT step, 'eval/' || metric AS metric, round(value, 6) AS value FROM (UNPIVOT ("
                        + ORACLE["summary_wide"] + ") ON "
                        + ", ".join(f'"{o}"' for o, _ in _SUMMARY_COLS) + " INTO NAME metric VALUE value)")

ORACLE["per_example"] = with_views(["eval_pairs"], f"""
SELECT p.step::BIGINT AS step, p.example_id::BIGINT AS example_id, p.source, p.prediction,
       array_to_string(p."references", '{SEP}') AS refs_text, round(b.chrf, 6) AS chrf, round(m.meteor, 6) AS meteor
FROM eval_pairs p LEFT JOIN best b USING (step, example_id) LEFT JOIN mex m USING (step, example_id)""",
                                   extra=_chrf_cte() + _meteor_ctes())

ORACLE["run_keys"] = """
SELECT doc_id::BIGINT AS doc_id, translate('org-' || source || '/model-' || lang, '/', '_') AS run_key,
       regexp_extract(path, '([^.]*)$', 1) AS suffix,
       regexp_replace(path, '\\.csv$', '_heavy_overall.csv') AS heavy_path
FROM (SELECT doc_id, source, lang, 'runs/' || source || '/outputs_eval-' || CAST(doc_id AS VARCHAR) || '.csv' AS path
      FROM documents)"""

# ============================================================ tokens
from lexeval.operators import tokens as _T  # noqa: E402

_K = 500
_specials = ", ".join(f"('{t}', {i})" for i, t in enumerate(_T.SPECIALS))
_langs = ", ".join(f"('{t}', {len(_T.SPECIALS) + _K + i})" for i, t in enumerate(_T.lang_tokens()))
_reserved = ", ".join(f"'{t}'" for t in _T.SPECIALS + _T.lang_tokens())
_VOCAB = ("vocab", f"""
SELECT * FROM (VALUES {_specials}) v(token, id)
UNION ALL
SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + {len(_T.SPECIALS) - 1}) AS id FROM (
  SELECT token, count(*) AS cnt FROM (SELECT unnest({S.words('text')}) AS token FROM documents)
  WHERE token NOT IN ({_reserved})
  GROUP BY token ORDER BY cnt DESC, token LIMIT {_K})
UNION ALL
SELECT * FROM (VALUES {_langs}) l(token, id)""")

ORACLE["vocab"] = with_views([], "SELECT token, id::BIGINT AS id FROM vocab", extra=[_VOCAB])


_ALL = 1 << 31  # no truncation


def _encode_ctes(src_sql: str, max_src: int = 1024, max_tgt: int = 128) -> list[tuple[str, str]]:
    """``enc(example_id, ids, lab)``: looked-up, truncated ids (+ end id)."""
    return [
        _VOCAB,
        ("src", src_sql),
        ("ti", "SELECT example_id, unnest(wi) AS token, generate_subscripts(wi, 1) AS pos FROM src"),
        ("tt", "SELECT example_id, unnest(wt) AS token, generate_subscripts(wt, 1) AS pos FROM src"),
        ("ii", """SELECT t.example_id, list(coalesce(v.id, 2) ORDER BY t.pos) AS ids
                  FROM ti t LEFT JOIN vocab v USING (token) GROUP BY t.example_id"""),
        ("il", """SELECT t.example_id, list(coalesce(v.id, 2) ORDER BY t.pos) AS ids
                  FROM tt t LEFT JOIN vocab v USING (token) GROUP BY t.example_id"""),
        ("enc", f"""SELECT s.example_id,
                       list_concat(coalesce(ii.ids, []::INTEGER[])[1:{max_src - 1}], [1]) AS ids,
                       list_concat(coalesce(il.ids, []::INTEGER[])[1:{max_tgt - 1}], [1]) AS lab
                    FROM src s LEFT JOIN ii USING (example_id) LEFT JOIN il USING (example_id)"""),
    ]


def _pad(x: str, n: int, v: int) -> str:
    return f"list_concat({x}, list_transform(range(greatest({n} - len({x}), 0)), lambda i: {v}))"


_TR_SRC = (f"SELECT example_id, {S.words('translation.en')} AS wi, {S.words('translation.cs')} AS wt "
           f"FROM translations")
_DOC_SRC = f"SELECT doc_id AS example_id, {S.words('text')} AS wi, {S.words('text')} AS wt FROM documents"
_MASKED = f"list_transform({_pad('lab', 128, 0)}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)"

ORACLE["encode_padded"] = with_views(["translations"], f"""
SELECT example_id::BIGINT AS example_id, array_to_string({_pad('ids', 1024, 0)}, ' ') AS input_ids,
       array_to_string(list_concat(list_transform(range(len(ids)), lambda i: 1),
                                   list_transform(range(greatest(1024 - len(ids), 0)), lambda i: 0)), ' ')
         AS attention_mask,
       array_to_string({_MASKED}, ' ') AS labels
FROM enc""", extra=_encode_ctes(_TR_SRC))

ORACLE["encode_unpadded"] = with_views([], """
SELECT example_id::BIGINT AS example_id, array_to_string(ids, ' ') AS input_ids, array_to_string(lab, ' ') AS labels
FROM enc""", extra=_encode_ctes(_DOC_SRC))

ORACLE["collate_batches"] = with_views([], f"""
SELECT e.example_id::BIGINT AS example_id, e.batch_id::BIGINT AS batch_id,
       array_to_string({_pad('e.ids', 'w.w_in', 0)}, ' ') AS input_ids,
       array_to_string(list_concat(list_transform(range(len(e.ids)), lambda i: 1),
                                   list_transform(range(w.w_in - len(e.ids)), lambda i: 0)), ' ') AS attention_mask,
       array_to_string({_pad('e.lab', 'w.w_lab', -100)}, ' ') AS labels
FROM (SELECT *, example_id // 8 AS batch_id FROM enc) e
JOIN (SELECT example_id // 8 AS batch_id, (ceil(max(len(ids)) / 8.0) * 8)::BIGINT AS w_in,
             (ceil(max(len(lab)) / 8.0) * 8)::BIGINT AS w_lab FROM enc GROUP BY 1) w USING (batch_id)""",
                                       extra=_encode_ctes(_DOC_SRC))

ORACLE["decoder_inputs"] = with_views(["translations"], f"""
SELECT example_id::BIGINT AS example_id,
       array_to_string(list_transform(list_concat([1], m[1:len(m) - 1]),
                                      lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ' ') AS decoder_input_ids
FROM (SELECT example_id, {_MASKED} AS m FROM enc)""", extra=_encode_ctes(_TR_SRC))

ORACLE["decode"] = with_views(["translations"], f"""
SELECT e.example_id::BIGINT AS example_id, coalesce(regexp_replace(d.t, '^{S.WS}|{S.WS}$', '', 'g'), '') AS text
FROM enc e LEFT JOIN (
  SELECT u.example_id, array_to_string(list(coalesce(v.token, '<unk>') ORDER BY u.pos), ' ') AS t
  FROM (SELECT example_id, unnest(lab) AS id, generate_subscripts(lab, 1) AS pos FROM enc) u
  LEFT JOIN vocab v USING (id)
  WHERE u.id <> -100 AND u.id NOT IN (0, 1, 2, 3)
  GROUP BY u.example_id) d USING (example_id)""", extra=_encode_ctes(_TR_SRC, _ALL, _ALL))

_fams = list(_T.LANG_CODES)
ORACLE["lang_tag"] = with_views(["translations"], f"""
SELECT e.example_id::BIGINT AS example_id, f.family, array_to_string(list_concat([v.id], e.lab), ' ') AS labels
FROM (SELECT *, {[f for f in _fams]}[example_id % {len(_fams)} + 1] AS family FROM enc) e
JOIN (SELECT * FROM (VALUES {", ".join(f"('{f}', '{_T.lang_token(f, t)}')" for f, (s, t) in _T.LANG_CODES.items())})
      x(family, tgt)) f USING (family)
JOIN vocab v ON v.token = f.tgt""", extra=_encode_ctes(_TR_SRC, _ALL, _ALL))

ORACLE["rouge_l_per_example"] = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, example_id::BIGINT AS example_id, round(p, 6) AS rougeL_precision,
       round(r, 6) AS rougeL_recall, round(f, 6) AS rougeL
FROM eval_pairs LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step, example_id ORDER BY round(f, 9) DESC, k) AS rn
      FROM (SELECT step, example_id, k,
                   CASE WHEN la > 0 THEN l / la ELSE 0.0 END AS p, CASE WHEN lb > 0 THEN l / lb ELSE 0.0 END AS r,
                   CASE WHEN la > 0 AND lb > 0 AND l > 0 THEN 2.0 * (l / la) * (l / lb) / (l / la + l / lb)
                        ELSE 0.0 END AS f
            FROM (SELECT *, len(a) AS lb, len(b) AS la,
                         CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE """ + _LCS + """ END AS l
                  FROM (SELECT step, example_id, k, """ + S.rouge_tokens("rt") + """ AS a,
                               """ + S.rouge_tokens("prediction") + """ AS b
                        FROM (SELECT step, example_id, prediction,
                                     unnest(""" + S.usable_refs() + """) AS rt,
                                     generate_subscripts(""" + S.usable_refs() + """, 1) AS k
                              FROM eval_pairs)))))
WHERE rn = 1) USING (step, example_id)""")
