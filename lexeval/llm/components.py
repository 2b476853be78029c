"""Connected components and candidate pairs inside hash buckets.

Both work on tables of any size: no group, link or component is gathered in a
task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeval.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``; ``component`` is the
    smallest id reachable.  Ids may be of any orderable type.

    Contraction: each vertex points to the smallest vertex of its closed
    neighbourhood, pointers are doubled once, links are rewritten to the
    pointed-to vertices, and loops and repeats go.  The remaining links shrink
    every round; rounds end when none is left.  Minimum and distinct are
    pre-aggregated before each shuffle, and hub vertices meet joins whose other
    side has one row a vertex, which the runtime skew handling can split."""
    links = links.select("a", "b").where("a <> b").distinct()
    label = None
    while True:
        links = stage(links, "links")
        if links.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        point = stage(near.select("id", F.least("id", "low").alias("p")), "pointers")
        jump = point.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        point = stage(point.join(jump, "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "pointers")
        if label is None:
            label = point.select("id", F.col("p").alias("component"))
        else:
            step = point.select(F.col("id").alias("component"), "p")
            label = label.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = stage(label, "labels")
        to_a = point.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        to_b = point.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        links = (links.join(to_a, "a").join(to_b, "b").where("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if label is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """``buckets(key, id)`` reduced to keys with two or more ids, with the
    smallest and largest id of the key as ``low`` and ``high`` and the number of
    rows as ``members``.  The aggregate is pre-combined per task; the join back
    can be split where one key is hot."""
    keys = (buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                       F.count(F.lit(1)).alias("members")).where("low <> high"))
    return buckets.join(keys, "key")


def _with_hubs(rows: DataFrame, hubs: list[str]) -> DataFrame:
    """(a, b), a < b: every id with the hub that most of its keys name, for each
    column of hubs; one pair a row, however many keys and ids meet."""
    best = rows.groupBy("id").agg(*[F.mode(h, True).alias(h) for h in hubs])
    pairs = best.select("id", F.explode(F.array(*hubs)).alias("hub")).where("id <> hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of every id with a smallest and a largest id of its keys."""
    return _with_hubs(shared, ["low", "high"])


def bridge_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of :func:`open_buckets` rows with the smallest id of
    another component in their key."""
    hub = rows.groupBy("key").agg(F.min(F.struct("component", "id")).alias("hub"))
    far = rows.join(hub, "key").where("component <> hub.component").select("id", F.col("hub.id").alias("low"))
    return _with_hubs(far, ["low"])


def open_buckets(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (key, id, component, members) of the keys whose ids still lie in
    more than one component.  Pairs inside a component need no further look;
    ``members`` counts the key's rows."""
    known = (shared.select("key", "id").join(label, "id", "left")
             .select("key", "id", F.coalesce("component", "id").alias("component")))
    keys = (known.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                     F.count(F.lit(1)).alias("members")).where("c0 <> c1").select("key", "members"))
    return known.join(keys, "key")
