"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's statistics are compared with fences around its own group's
quartiles instead of fixed cutoffs.  A group is a (lang, source) pair.  Its
quartiles come from KLL quantile sketches, one per statistic, built with
map-side partial sketches; groups with fewer than ``LEAST`` documents use their
language's sketch, and languages with fewer the whole corpus's, both merged
from the group sketches without another look at the documents.  The thresholds
are joined back to the statistics to filter them.

Statistics: words are runs of non-white-space (``[^\\x20\\x09-\\x0D]+``);
``word_chars`` code points in words; ``n_symbols`` characters of ``#*$%&|<>``;
``n_upper`` letters A-Z; ``n_lines`` lines with a word; ``n_dup_lines`` of those
the ones equal to an earlier line; ``n_repeat_words`` words in windows of
``WINDOW`` words found twice or more in the text.

Base rules fail texts of fewer than 20 words or with more than 30 % repeated
words.  Of the rest, the method fails a text if a statistic lies outside
[q25 - WIDTH * spread, q75 + WIDTH * spread], spread being the interquartile
range or the statistic's floor if that is larger.

Defined cases.  A null or empty text has no words and fails the base rules.  A
null lang or source is a group of its own.  A corpus with no text that passes
the base rules has no thresholds and keeps nothing.  Repeated rows get equal
results; an empty table gives an empty result.  Windows are compared by 64-bit
hash within one text.  Only the named columns are read, so other columns cannot
clash; ``filter_documents`` passes all of them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeval.llm.common import any_of, fresh, let, stage

SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
SKETCH_K = 1024
LEAST = 100
WIDTH = 3.0
#: Statistic, its least spread, whether low values fail as well.  The spreads are
#: small, so quartiles that differ decide; where most texts have none of a thing
#: both are 0 and WIDTH times the least spread is the fence, which for repeated
#: words lies at half the base rule's limit.
RULES = (("word_length", 0.1, True), ("symbol_share", 0.03, False), ("upper_share", 0.002, False),
         ("dup_line_share", 0.08, False), ("repeat_share", 0.05, False))


def words_of(text: Column) -> Column:
    """Words of a text that is not null."""
    return let(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, SPACE_RE)))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""
    grams = F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def positions(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: any_of([F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False)) for j in (i - 1, i + 1)])),
            lambda x: x["i"])))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                           F.lit(0), lambda a, x: a + x)

    # most texts repeat no window: a hash set tells, and only the others are sorted
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
        let(positions(g), covered))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
                lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                   (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    out = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        counts.alias("w"), F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"), count_of(text, UPPER).alias("n_upper"), lines.alias("l"))
    return out.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                      F.col("l.dup").alias("n_dup_lines"), F.col("w.repeat").alias("n_repeat_words"),
                      F.col("l.n").alias("n_lines"), "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    """The statistics that have thresholds, null for texts without words: an
    expression that occurs twice is computed for every row, also for those that
    the base rules fail, so the division itself must allow a zero."""
    n = F.col("n_words").cast("double")
    return {"word_length": F.try_divide("word_chars", n), "symbol_share": F.try_divide("n_symbols", n),
            "upper_share": F.try_divide("n_upper", F.col("word_chars").cast("double")),
            "dup_line_share": F.try_divide("n_dup_lines", F.col("n_lines").cast("double")),
            "repeat_share": F.try_divide("n_repeat_words", n)}


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per (lang, source): the quartiles that hold for it."""
    passed = stats.where(~base_failed()).select("lang", "source", *[m.alias(k) for k, m in _measures().items()])
    names = [k for k, _, _ in RULES]
    group = stage(passed.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in names]), "sketches")

    def merged(rows, keys, to):
        return rows.groupBy(*keys).agg(F.sum("n").alias(f"{to}_n"), *[
            F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(f"{to}_{k}") for k in names])

    lang = merged(group, ["lang"], "lang")
    whole = merged(lang.select("lang", F.col("lang_n").alias("n"), *[F.col(f"lang_{k}").alias(k) for k in names]), [], "all")
    up = lang.withColumnRenamed("lang", "up").withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").drop("one")
    all_groups = stats.select("lang", "source").distinct()  # also those in which every text failed
    joined = (all_groups.join(group.withColumnsRenamed({"lang": "gl", "source": "gs"}),
                              F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left")
              .join(up, F.col("lang").eqNullSafe(F.col("up")), "left"))

    def fence(k, floor, low):
        sketch = F.when(F.col("n") >= LEAST, F.col(k)).when(F.col("lang_n") >= LEAST, F.col(f"lang_{k}")).otherwise(F.col(f"all_{k}"))
        return let(F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.75))), lambda q: F.struct(
            (q[0] - WIDTH * F.greatest(q[1] - q[0], F.lit(floor)) if low else F.lit(float("-inf"))).alias("low"),
            (q[1] + WIDTH * F.greatest(q[1] - q[0], F.lit(floor))).alias("high")))

    return joined.select("lang", "source", *[fence(*rule).alias(f"t_{rule[0]}") for rule in RULES])


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``: the thresholds joined to
    each row.  The side of the thresholds has one row a group; a hot group's
    rows can be split by the runtime skew handling."""
    limits = limits.withColumnsRenamed({"lang": "tl", "source": "ts"})
    both = stats.join(limits, F.col("lang").eqNullSafe(F.col("tl")) & F.col("source").eqNullSafe(F.col("ts")), "left")
    inside = F.lit(True)
    for k, m in _measures().items():
        inside = inside & (m >= F.col(f"t_{k}.low")) & (m <= F.col(f"t_{k}.high"))
    return both.select(*stats.columns, base_failed().alias("base_failed"),
                       (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs(doc_id, text, lang, source)``."""
    stats = stage(statistics(docs), "statistics")
    return judged(stats, stage(thresholds(stats), "thresholds"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    row = fresh(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = rows.select(F.col(row).alias("doc_id"), "text", "lang", "source")
    kept = quality_rules(named).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def oracle_sql() -> str:
    """DuckDB SQL of the verdict; quantiles are exact there, as the sketches are
    while a group has at most SKETCH_K rows."""
    names = [k for k, _, _ in RULES]
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    pick = lambda k, q: f"{k}[greatest(1, CAST(ceil({q} * len({k})) AS BIGINT))]"
    lists = ", ".join(f"list_sort(list({k})) AS {k}" for k in names)
    chosen = ", ".join(f"CASE WHEN g.n >= {LEAST} THEN g.{k} WHEN l.n >= {LEAST} THEN l.{k} ELSE a.{k} END AS {k}" for k in names)
    bounds = ", ".join(f"{pick(k, 0.25)} AS lo_{k}, {pick(k, 0.75)} AS hi_{k}" for k in names)
    inside = " AND ".join(
        f"m.{k} <= hi_{k} + {WIDTH} * greatest(hi_{k} - lo_{k}, {f}::DOUBLE)"
        + (f" AND m.{k} >= lo_{k} - {WIDTH} * greatest(hi_{k} - lo_{k}, {f}::DOUBLE)" if low else "") for k, f, low in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w WHERE len(ws) >= {WINDOW}),
gram AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS g FROM pos),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM gram) WHERE c > 1) GROUP BY rid),
s AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(t) - length(translate(t, '{UPPER}', '')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
m AS (SELECT *, word_chars / n_words::DOUBLE AS word_length, n_symbols / n_words::DOUBLE AS symbol_share,
        n_upper / word_chars::DOUBLE AS upper_share, n_dup_lines / n_lines::DOUBLE AS dup_line_share,
        n_repeat_words / n_words::DOUBLE AS repeat_share FROM b WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {lists} FROM m GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {lists} FROM m GROUP BY lang),
a AS (SELECT count(*) AS n, {lists} FROM m),
c AS (SELECT g.lang, g.source, {chosen} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a),
q AS (SELECT lang, source, {bounds} FROM c),
ok AS (SELECT rid FROM m JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source
       WHERE {inside})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       rid IN (SELECT rid FROM ok) AS kept, n_lines, n_upper
FROM b"""
