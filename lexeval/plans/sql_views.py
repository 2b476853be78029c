"""DuckDB twins of ``lexeval.plans.views`` and SQL expression helpers.

These strings are the independent oracle for the driver's value check: each
registered query has an ANSI/DuckDB SQL statement built from the same base
tables.  ``with_views(names, body)`` prefixes the needed views as CTEs.
"""

from __future__ import annotations

from lexeval.functions.text import CHRF_PUNCT, WS, WS_CLASS  # noqa: F401

# ------------------------------------------------------------ expressions

def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda t: t <> '')"


def tok13a(x: str, lower: bool = False) -> str:
    s = f"lower({x})" if lower else x
    s = f"replace(replace(replace({s}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    s = f"replace(replace(replace(replace({s}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    s = f"(' ' || {s} || ' ')"
    s = f"regexp_replace({s}, '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return words(s)


def ngrams(t: str, n: int) -> str:
    """n-grams of a token-list *column* (the name is captured by the lambda)."""
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def char_ngrams(s: str, n: int) -> str:
    return f"list_transform(range(1, length({s}) - {n} + 2), lambda i: substring({s}, i, {n}))"


def chrf_chars(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


_P = CHRF_PUNCT.replace("'", "''")


def chrf_words(x: str) -> str:
    return (f"flatten(list_transform({words(x)}, lambda w: CASE WHEN length(w) = 1 THEN [w] "
            f"WHEN contains('{_P}', right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)] "
            f"WHEN contains('{_P}', left(w, 1)) THEN [left(w, 1), substring(w, 2)] ELSE [w] END))")


def rouge_tokens(x: str) -> str:
    return words(f"regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')")


def usable_refs(x: str = "\"references\"") -> str:
    return f"list_filter(coalesce({x}, []::VARCHAR[]), lambda r: r IS NOT NULL AND r <> '')"


def split_of(x: str) -> str:
    return f"CASE ({x}) % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"


# ------------------------------------------------------------------ views
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("eval_refs", (), f"""
SELECT conv_id * 100 + turn AS example_id,
       concat_ws(' - ', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role) AS source,
       CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN []::VARCHAR[] WHEN conv_id % 10 = 4 AND turn = 1 THEN ['']
            WHEN turn % 3 = 0 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w, ' '), array_to_string(list_filter(w, lambda x, i: i % 7 <> 0), ' ')] END
         AS "references"
FROM (SELECT *, {words('text')} AS w FROM conversations)""")

_view("eval_preds", (), f"""
SELECT step, conv_id * 100 + turn AS example_id,
       array_to_string(list_filter(w, lambda x, i: i % (4 * step) <> 0), ' ') AS prediction
FROM (SELECT conv_id, turn, unnest([1, 2, 3]) AS step, {words('text')} AS w FROM conversations)""")

_view("eval_pairs", ("eval_preds", "eval_refs"), """
SELECT p.step, p.example_id, p.prediction, r.source, r."references"
FROM eval_preds p JOIN eval_refs r USING (example_id)""")

_view("ref_groups", (), f"""
SELECT example_id, {split_of('example_id')} AS split,
       {{'mtriple_set': [list(concat_ws(' | ', CAST(doc_id AS VARCHAR), lang, source) ORDER BY doc_id)]}}
         AS modified_triple_sets,
       {{'text': list(text ORDER BY doc_id), 'lang': list(lang ORDER BY doc_id),
        'source': list(source ORDER BY doc_id)}} AS lex
FROM (SELECT *, doc_id // 10 AS example_id FROM documents) GROUP BY example_id""")

_view("ref_filtered", ("ref_groups",), """
SELECT example_id, split, modified_triple_sets,
       list_transform(list_filter(
           list_transform(lex.text[1:least(len(lex.text), len(lex.lang), len(lex.source))],
                          lambda t, i: {'text': t, 'lang': lex.lang[i], 'source': lex.source[i]}),
           lambda x: x.lang = 'en' AND contains(x.source, 'src1')), lambda x: x.text) AS lex
FROM ref_groups""")

_view("triple_sets", (), """
SELECT l_orderkey AS example_id,
       {'mtriple_set': [list(concat_ws(' | ', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                                       CAST(l_linenumber AS VARCHAR))
                             ORDER BY l_linenumber, l_partkey, l_suppkey)]} AS modified_triple_sets
FROM lineitem GROUP BY l_orderkey""")

_view("translations", (), f"""
SELECT u.conv_id * 100 + u.turn AS example_id, {split_of('u.conv_id')} AS split,
       {{'en': u.text, 'cs': a.text}} AS translation
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")

_view("dialogue_acts", (), f"""
SELECT conv_id * 100 + turn AS example_id, {split_of('conv_id')} AS split, role AS da, text
FROM conversations""")

_view("splits", (), f"""
SELECT doc_id AS example_id, {split_of('doc_id')} AS split, text AS input, lang FROM documents""")

_view("scored_refs", ("ref_filtered",), """
SELECT example_id, ref_idx - 1 AS ref_idx, reference, length(reference) / 1000.0 AS score
FROM (SELECT example_id, unnest(lex) AS reference, generate_subscripts(lex, 1) AS ref_idx FROM ref_filtered)""")

_view("dedup_stream", (), """
SELECT user_id AS run, ts AS pos, event_type AS source, event_id AS prediction FROM events""")

_view("token_vectors", (), """
SELECT vec_id // 10 AS example_id, CASE WHEN vec_id % 10 <= 3 THEN 'cand' ELSE 'ref' END AS side,
       CAST(CASE WHEN vec_id % 10 <= 3 THEN NULL WHEN vec_id % 10 <= 6 THEN 0 ELSE 1 END AS INTEGER) AS ref_idx,
       vec_id AS tok, embedding
FROM embeddings""")


def with_views(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies, in
    dependency order) followed by ``extra`` CTEs and the ``body`` query."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
