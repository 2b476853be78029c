"""URL filter by a character language-model ratio, in DataFrame functions only.

Rules give some URLs a verdict.  From those, two variable-order Markov models
of characters are learned, one for accepted and one for blocked URLs, with
contexts of up to ``ORDER`` characters and Witten-Bell smoothing: a context
that was never seen hands all its weight to the next shorter one.  Every other
URL is judged by the difference of the two log-likelihoods divided by its
length, against a threshold that is calibrated on labelled URLs kept out of the
counts.

The text of a URL is its host and path, between ``ORDER`` start characters and
one end character.  A text counts once, however many rows have it.  Counts of
the longest grams hold all others, so the corpus is exploded once; each order's
probabilities are a join of small tables of distinct grams.

Threshold: scores are cut into steps of 1 / ``STEPS`` between -``SPAN`` and
``SPAN``, and the lowest step with the best balanced accuracy on the kept-out
texts is taken; 0 if one kind of label is missing there.

Defined cases.  A null URL or one without ``://`` has an empty host and path;
it fits no rule and is blocked.  If one kind of label is missing altogether,
the models do not differ, the score is 0 and such URLs are allowed.  Repeated
rows get equal verdicts; an empty table gives an empty result.  Only
``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeval.llm.common import stage

ORDER = 4
STEPS, SPAN = 200, 10
START, END = "\x02", "\x03"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, _AZ, _AZ.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    padded = F.concat(F.lit(START * ORDER), F.col("s"), F.lit(END))
    return texts.select(*keep, padded.alias("p")).select(
        *keep, F.explode(F.sequence(F.lit(1), F.length("p") - ORDER)).alias("i"), "p").select(
        *keep, F.substring("p", F.col("i"), F.lit(ORDER + 1)).alias("g"))


def kept_out(text: Column) -> Column:
    """About a fifth of the texts, by a hash."""
    return F.substring(F.md5(text.cast("binary")), 1, 1).isin("0", "1", "2")


def gram_ratios(texts: DataFrame) -> DataFrame:
    """(g, ratio) for every gram of ``texts(s, allowed)``: the logarithm of the
    accepted model's probability of its last character after the others over
    the blocked model's.  Counts are of labelled texts that are not kept out."""
    learn = ~kept_out(F.col("s")) & F.col("allowed").isNotNull()
    marked = texts.select("s", F.when(learn & F.col("allowed"), 1).otherwise(0).alias("a"),
                          F.when(learn & ~F.col("allowed"), 1).otherwise(0).alias("b"))
    longest = stage(_grams(marked, "a", "b").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")
    shorter = {ORDER: longest}
    for k in range(ORDER - 1, -1, -1):  # each order's counts are sums of the next longer one's
        shorter[k] = shorter[k + 1].groupBy(F.right("g", F.lit(k + 1)).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = shorter[0].agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("ta"),
                           F.count_if(F.col("b") > 0).alias("tb"), F.count(F.lit(1)).alias("v")).first()
    single = (total.a or 0) == 0 or (total.b or 0) == 0
    if single:
        return longest.select("g", F.lit(0.0).alias("ratio"))

    def smooth(count, types, n, below):
        return (F.col(count) + types * below) / (n + types)

    flat = F.lit(1.0 / total.v)
    below = shorter[0].select("g", smooth("a", F.lit(total.ta), F.lit(total.a), flat).alias("pa"),
                              smooth("b", F.lit(total.tb), F.lit(total.b), flat).alias("pb"))
    for k in range(1, ORDER + 1):
        here = shorter[k]
        context = here.groupBy(F.left("g", F.lit(k)).alias("c")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        low = below.select(F.col("g").alias("l"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
        below = here.join(context, F.left("g", F.lit(k)) == F.col("c")).join(low, F.right("g", F.lit(k)) == F.col("l")).select(
            "g", F.when(F.col("na") > 0, smooth("a", F.col("ta"), F.col("na"), F.col("la"))).otherwise(F.col("la")).alias("pa"),
            F.when(F.col("nb") > 0, smooth("b", F.col("tb"), F.col("nb"), F.col("lb"))).otherwise(F.col("lb")).alias("pb"))
    return below.select("g", (F.log("pa") - F.log("pb")).alias("ratio"))


def text_scores(texts: DataFrame) -> DataFrame:
    """(s, allowed, score) of each distinct text: the mean ratio of its grams."""
    texts = stage(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    ratios = stage(gram_ratios(texts), "ratios")
    scores = _grams(texts, "t").join(ratios, "g").groupBy("t").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    return texts.join(scores, "t").select("s", "allowed", "score")


def calibrate(scores: DataFrame) -> float:
    """Threshold from the kept-out labelled texts; 2 * STEPS * SPAN + 1 steps at most."""
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(SPAN)), F.lit(-SPAN)) * STEPS)
    rows = (scores.where(kept_out(F.col("s")) & F.col("allowed").isNotNull()).groupBy(step.alias("step"))
            .agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).orderBy("step").collect())
    na, nb = sum(r.a for r in rows), sum(r.b for r in rows)
    if not na or not nb:
        return 0.0
    best, at, above, under = -1, 0, na, 0
    for r in rows:  # allow what scores this step or more
        if (value := above * nb + under * na) > best:
            best, at = value, r.step
        above, under = above - r.a, under + r.b
    return at / STEPS


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages(page_id, url)``."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.cast("string").alias("rule"), verdict.cast("string").alias("given"),
                       F.concat("host", "path").alias("s"))
    texts = rows.where("s <> ''").groupBy("s").agg(F.any_value(F.col("given") == "allow").alias("allowed"))
    scores = stage(text_scores(texts), "scores")
    threshold = calibrate(scores)
    judged = scores.select("s", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("own"))
    return rows.join(judged, "s", "left").select("page_id", "host", "path", "rule",
                                                 F.coalesce("given", "own", F.lit("block")).alias("verdict"))


def oracle_sql() -> str:
    """DuckDB SQL of the same verdicts."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    given = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    n = ORDER + 1
    pad = " || ".join(["chr(2)"] * ORDER)
    orders = [f"n{ORDER} AS (SELECT g, sum(a) AS a, sum(b) AS b FROM grams GROUP BY g)"]
    for k in range(ORDER - 1, -1, -1):
        orders.append(f"n{k} AS (SELECT right(g, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM n{k + 1} GROUP BY 1)")
    orders.append("tot AS (SELECT sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb, "
                  "1.0 / count(*)::DOUBLE AS u FROM n0)")
    orders.append("p0 AS (SELECT g, (n0.a + ta * u) / (tot.a + ta) AS pa, (n0.b + tb * u) / (tot.b + tb) AS pb FROM n0, tot)")
    for k in range(1, ORDER + 1):
        orders.append(f"c{k} AS (SELECT left(g, {k}) AS c, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, count(*) FILTER (a > 0) AS ta, "
                      f"count(*) FILTER (b > 0) AS tb FROM n{k} GROUP BY 1)")
        orders.append(f"p{k} AS (SELECT h.g, CASE WHEN na > 0 THEN (h.a + ta * l.pa) / (na + ta) ELSE l.pa END AS pa, "
                      f"CASE WHEN nb > 0 THEN (h.b + tb * l.pb) / (nb + tb) ELSE l.pb END AS pb FROM n{k} h "
                      f"JOIN c{k} ON left(h.g, {k}) = c JOIN p{k - 1} l ON right(h.g, {k}) = l.g)")
    out = "left(md5(s), 1) IN ('0', '1', '2')"
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_AZ}', '{_AZ.lower()}') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, {rule} AS rule, {given} AS given, host || path AS s FROM h),
t AS (SELECT s, any_value(given) = 'allow' AS allowed FROM r WHERE s <> '' GROUP BY s),
grams AS (SELECT s, substr(p, i, {n}) AS g, CASE WHEN learn AND allowed THEN 1 ELSE 0 END AS a,
                 CASE WHEN learn AND NOT allowed THEN 1 ELSE 0 END AS b
          FROM (SELECT s, p, allowed, learn, unnest(range(1, length(p) - {ORDER} + 1)) AS i
                FROM (SELECT s, allowed, {pad} || s || chr(3) AS p, allowed IS NOT NULL AND NOT {out} AS learn FROM t))),
{(',' + chr(10)).join(orders)},
sc AS (SELECT s, sum(CASE WHEN (SELECT a > 0 AND b > 0 FROM tot) THEN ln(pa) - ln(pb) ELSE 0 END) / count(*) AS score
       FROM grams JOIN p{ORDER} USING (g) GROUP BY s),
cal AS (SELECT floor(greatest(least(score, {SPAN}), -{SPAN}) * {STEPS}) AS step, count(*) FILTER (allowed) AS a,
               count(*) FILTER (NOT allowed) AS b
        FROM sc JOIN t USING (s) WHERE allowed IS NOT NULL AND {out} GROUP BY 1),
val AS (SELECT step, (SELECT sum(a) FROM cal) AS na, (SELECT sum(b) FROM cal) AS nb,
               sum(a) OVER (ORDER BY step DESC) AS above, sum(b) OVER (ORDER BY step) - b AS under FROM cal),
best AS (SELECT coalesce((SELECT step / {STEPS} FROM val WHERE na > 0 AND nb > 0
                          ORDER BY above * nb + under * na DESC, step LIMIT 1), 0) AS x)
SELECT page_id, host, path, rule,
       CASE WHEN given IS NOT NULL THEN given WHEN score >= (SELECT x FROM best) THEN 'allow' ELSE 'block' END AS verdict
FROM r LEFT JOIN sc USING (s)"""
