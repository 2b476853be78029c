"""SQL of corpus TER for a small fixture: too slow to be the query's registered
twin at larger sizes (minutes at sf0.01, seconds at sf0.001)."""

from lexeval.plans import sql_views as S
from lexeval.plans.oracle import _ED
from lexeval.plans.sql_views import with_views

# Greedy shift search, one round per level of the recursion, every candidate by
# a full edit distance.  Positions count from 1; ``d`` holds the distance rows.  A
# pair that differs by insertions or deletions alone has no word to move.
_TER_D = """list_reduce(h, lambda m, x: list_append(m, list_reduce(range(1, len(r) + 1),
              lambda c, j: list_append(c, least(m[-1][j + 1] + 1, c[j] + 1, m[-1][j] + CASE WHEN x = r[j] THEN 0 ELSE 1 END)),
              [m[-1][1] + 1])), [range(len(r) + 1)])"""
# back-trace: matched hypothesis and reference positions, and for each reference
# word (last first) the number of hypothesis words before the place it aligns with
_TER_B = """list_reduce(range(len(h) + len(r)), lambda b, z: CASE
    WHEN b.i = 0 AND b.j = 0 THEN b
    WHEN b.i > 0 AND b.j > 0 AND d[b.i + 1][b.j + 1] = d[b.i][b.j] + CASE WHEN h[b.i] = r[b.j] THEN 0 ELSE 1 END
      THEN {'i': b.i - 1, 'j': b.j - 1, 'hm': CASE WHEN h[b.i] = r[b.j] THEN list_append(b.hm, b.i) ELSE b.hm END,
            'rm': CASE WHEN h[b.i] = r[b.j] THEN list_append(b.rm, b.j) ELSE b.rm END, 't': list_append(b.t, b.i - 1)}
    WHEN b.j > 0 AND d[b.i + 1][b.j + 1] = d[b.i + 1][b.j] + 1
      THEN {'i': b.i, 'j': b.j - 1, 'hm': b.hm, 'rm': b.rm, 't': list_append(b.t, b.i)}
    ELSE {'i': b.i - 1, 'j': b.j, 'hm': b.hm, 'rm': b.rm, 't': b.t} END,
  {'i': len(h), 'j': len(r), 'hm': []::BIGINT[], 'rm': []::BIGINT[], 't': []::BIGINT[]})"""
_TER_C = """flatten(flatten(list_transform(list_filter(range(1, len(h) + 1), lambda s: NOT list_contains(b.hm, s)), lambda s:
    list_transform(list_filter(range(1, len(r) + 1), lambda j: r[j] = h[s] AND NOT list_contains(b.rm, j)), lambda j:
      list_transform(list_filter(range(1, 11), lambda n: s + n - 1 <= len(h) AND j + n - 1 <= len(r)
                                 AND h[s:s + n - 1] = r[j:j + n - 1]
                                 AND NOT (b.t[len(r) - j + 1] BETWEEN s - 1 AND s - 1 + n)
                                 AND abs(b.t[len(r) - j + 1] - (s - 1)) <= 50),
        lambda n: {'n': n, 's': s - 1, 't': b.t[len(r) - j + 1]})))))"""
_TER_M = """list_transform(c, lambda x: {'n': x.n, 's': x.s, 't': x.t, 'h': CASE WHEN x.t > x.s
    THEN list_concat(list_concat(h[1:x.s], h[x.s + x.n + 1:x.t]), list_concat(h[x.s + 1:x.s + x.n], h[x.t + 1:len(h)]))
    ELSE list_concat(list_concat(h[1:x.t], h[x.s + 1:x.s + x.n]), list_concat(h[x.t + 1:x.s], h[x.s + x.n + 1:len(h)])) END})"""
_TER_G = """list_sort(list_filter(list_transform(m, lambda x: {'g': -(d[-1][-1] - 1 - list_reduce(x.h, lambda p, w:
      list_reduce(range(1, len(r) + 1), lambda e, j: list_append(e, least(p[j + 1] + 1, e[j] + 1,
        p[j] + CASE WHEN w = r[j] THEN 0 ELSE 1 END)), [p[1] + 1]), range(len(r) + 1))[-1]),
    'n': -x.n, 's': x.s, 't': x.t, 'h': x.h}), lambda x: x.g < 0))"""

TER = with_views(["eval_pairs"], """
SELECT step::BIGINT AS step, round(CASE WHEN sum(l) > 0 THEN 100.0 * sum(e) / sum(l) WHEN sum(e) > 0 THEN 100.0 ELSE 0.0 END, 6) AS ter
FROM (SELECT step, example_id, min(e) AS e, avg(n) AS l
      FROM (SELECT step, example_id, k, max(CASE WHEN len(r) = 0 THEN len(h) ELSE shifts + cur END) FILTER (last) AS e, any_value(len(r)) AS n
            FROM (SELECT *, round_no = max(round_no) OVER (PARTITION BY step, example_id, k) AS last FROM shifted)
            GROUP BY ALL) GROUP BY ALL)
GROUP BY step""", extra=[
    ("tp", f"""SELECT step, example_id, k, {S.words("lower(prediction)")} AS h, {S.words("lower(x)")} AS r
               FROM (SELECT step, example_id, prediction, unnest({S.usable_refs()}) AS x,
                            generate_subscripts({S.usable_refs()}, 1) AS k FROM eval_pairs)"""),
    ("shifted", f"""
SELECT step, example_id, k, 0 AS round_no, h, r, 0 AS shifts, {_ED.replace('list_reduce(a,', 'list_reduce(h,').replace('len(b)', 'len(r)').replace('b[j]', 'r[j]')} AS cur,
       true AS more FROM tp
UNION ALL
SELECT step, example_id, k, round_no + 1, g[1].h, r, shifts + 1, cur + g[1].g - 1, cur + g[1].g - 1 > 0
FROM (SELECT *, {_TER_G} AS g FROM (SELECT *, {_TER_M} AS m FROM (SELECT *, {_TER_C} AS c FROM (SELECT *, {_TER_B} AS b
      FROM (SELECT *, {_TER_D} AS d FROM shifted WHERE more AND len(r) > 0 AND cur > abs(len(h) - len(r)))))))
WHERE len(g) > 0"""),
]).replace("WITH ", "WITH RECURSIVE ", 1)
