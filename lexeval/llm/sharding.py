"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash.  It starts as one
bucket; only a bucket above the byte limit is split on its next bit, until
every shard fits.  Shards are therefore known by (depth, prefix), and a row
belongs to the one whose prefix its hash starts with.

The directory is grown over counts, never over rows: bytes per hash cell of
``CELL_BITS`` bits are summed once (map-side combined) and rolled up to every
shorter prefix.  A bucket is a shard if it fits and its parent does not.  Cells
above the limit are refined by their next ``CELL_BITS`` bits, in rounds, over
those cells' rows alone.

The hash has ``KEY_BITS`` bits of the key and, after them, ``ROW_BITS`` bits of
a row number, so rows that share a hot key beyond the limit are split as well;
all bits of a key are spent first, so keys stay together where they can.  A
single row above the limit makes a shard of its own, marked ``oversized``.

``write_shards`` writes a folder per shard.  Its rows are dealt to one task per
``FILE_BYTES`` of the shard, so neither a shard nor a hot key waits for one task,
and a file stays small beside an executor's memory.

Defined cases.  A null key hashes like the text ``null``; a null size counts as
0, so an empty or null text adds nothing to ``row_bytes``.  Repeated rows are
counted one by one.  An empty table gives an empty result and a folder without
shards.  All columns are passed through; the column of the shard is called
``shard``, with as many ``_`` after it as it takes to clash with none of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexeval.llm.common import fresh, stage

KEY_BITS, ROW_BITS, CELL_BITS = 60, 60, 12
#: Byte limit of a shard, over the rows' values before encoding and compression.
SHARD_BYTES = 64 << 20
#: A shard is written by one task for each so many bytes, about.
FILE_BYTES = 8 << 20
#: A directory of at most so many shards (some 100 bytes each) is broadcast.
BROADCAST_SHARDS = 100_000


def _hash_bits(value: Column) -> Column:
    """60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _cell(at: int) -> Column:
    """Bits [at, at + CELL_BITS) of a row's hash."""
    column, shift = ("key", KEY_BITS - at - CELL_BITS) if at < KEY_BITS else ("tail", KEY_BITS + ROW_BITS - at - CELL_BITS)
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND((1 << CELL_BITS) - 1)


def _bits(cell: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a cell as text."""
    return F.substring(F.lpad(F.bin(cell), CELL_BITS, "0"), F.lit(1), depth)


def grow(rows: DataFrame, limit: int) -> DataFrame:
    """Shard directory (prefix, depth, bytes, rows) of ``rows(key, tail, bytes)``:
    ``prefix`` is the text of its bits."""
    todo, leaves, at = rows.withColumn("head", F.lit("")), None, 0
    while True:
        cells = stage(todo.groupBy("head", _cell(at).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
        if cells.isEmpty() and leaves is not None:
            return leaves
        levels = F.sequence(F.lit(0 if at == 0 else 1), F.lit(CELL_BITS))
        up = cells.select("head", "cell", "bytes", "rows", F.explode(levels).alias("depth")).select(
            "head", _bits(F.col("cell"), F.col("depth")).alias("bits"), "bytes", "rows").groupBy("head", "bits").agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        up = stage(up, "levels")
        last = at + CELL_BITS >= KEY_BITS + ROW_BITS
        # a bucket exists if its parent had to be split; it is a shard if it fits or cannot be split
        parents = up.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select(F.col("head").alias("ph"), F.col("bits").alias("pb"))
        exists = up.where(F.length("bits") > 0).join(
            parents, (F.col("head") == F.col("ph")) & (F.col("bits").substr(F.lit(1), F.length("bits") - 1) == F.col("pb")), "left_semi")
        if at == 0:
            exists = exists.union(up.where("bits = ''"))
        else:  # the first bit of a refined cell: its parent is the cell itself
            exists = exists.union(up.where("length(bits) = 1")).distinct()
        exists = stage(exists, "buckets")
        split = (F.col("bytes") > limit) & (F.col("rows") > 1)
        shards = exists.where(~split | F.lit(last) & (F.length("bits") == CELL_BITS)).select(
            F.concat("head", "bits").alias("prefix"), (F.lit(at) + F.length("bits")).alias("depth"), "bytes", "rows")
        leaves = shards if leaves is None else leaves.union(shards)
        if last:
            return leaves
        full = exists.where(split & (F.length("bits") == CELL_BITS)).select(F.col("head").alias("fh"), F.col("bits").alias("fb"))
        if full.isEmpty():
            return leaves
        cell_bits = _bits(_cell(at), F.lit(CELL_BITS))
        todo = todo.withColumn("cb", cell_bits).join(full, (F.col("head") == F.col("fh")) & (F.col("cb") == F.col("fb"))).select(
            "key", "tail", "bytes", F.concat("head", "cb").alias("head"))
        at += CELL_BITS


def row_bytes(docs: DataFrame) -> Column:
    """Bytes of a row's values: text and binary by their length, nested values by
    that of their JSON, 8 for any other."""
    def size(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)
    return reduce(add, [size(f).cast("long") for f in docs.schema.fields])


def shard_column(docs: DataFrame) -> str:
    """The name of the shard column beside the columns of ``docs``."""
    taken, name = {c.lower() for c in docs.columns}, "shard"
    while taken & {name, f"{name}_bytes", f"{name}_rows"}:
        name += "_"
    return name


def _numbered(docs: DataFrame, key: Column, size: Column, limit: int, shard: str, row: str) -> DataFrame:
    """``assign`` with the row number that splits hot keys in column ``row``."""
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hashes = [_hash_bits(key).alias("key"), _hash_bits(F.col(row)).alias("tail")]
    hashed = rows.select(F.col(row).alias("row"), *hashes, F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))
    directory = stage(grow(hashed, limit), "directory")
    found = directory.groupBy("depth").count().collect()  # KEY_BITS + ROW_BITS + 1 rows at most
    if not found:
        return rows.select("*", F.lit("").alias(shard), F.lit(0).cast("long").alias(f"{shard}_bytes"), F.lit(0).cast("long").alias(f"{shard}_rows"))
    text = F.concat(F.lpad(F.bin("key"), KEY_BITS, "0"), F.lpad(F.bin("tail"), ROW_BITS, "0"))
    own = [F.col("prefix").alias(shard), F.col("bytes").alias(f"{shard}_bytes"), F.col("rows").alias(f"{shard}_rows")]

    def look(df: DataFrame, carried: str, entries: DataFrame) -> DataFrame:
        """A row's hash has one prefix in the directory: look at the depths that occur."""
        depths = F.explode(F.array(*[F.lit(r.depth) for r in sorted(found, key=lambda r: r.depth)]))
        return (df.select(carried, text.alias("bits"), depths.alias("at"))
                .select(carried, F.substring("bits", F.lit(1), F.col("at")).alias("prefix")).join(entries.drop("depth"), "prefix"))

    if sum(r["count"] for r in found) <= BROADCAST_SHARDS:  # whole rows, never moved
        return look(rows.select(F.struct("*").alias("doc"), *hashes), "doc", F.broadcast(directory)).select("doc.*", *own)
    return rows.join(look(hashed.drop("bytes"), "row", directory).select(F.col("row").alias(row), *own), row)


def assign(docs: DataFrame, key: Column, size: Column, limit: int, shard: str | None = None) -> DataFrame:
    """``docs`` with column ``shard``, the bits of the row's shard (empty text if
    one shard holds all), and ``shard``_bytes, ``shard``_rows."""
    row = fresh(docs, "row")
    return _numbered(docs, key, size, limit, shard or shard_column(docs), row).drop(row)


def write_shards(docs: DataFrame, path: str, key: Column, size: Column, limit: int = SHARD_BYTES) -> None:
    """One Parquet folder per shard under ``path``; its name is ``b`` and the bits."""
    shard, row = shard_column(docs), fresh(docs, "row")
    out = _numbered(docs, key, size, limit, shard, row)
    files = F.ceil(F.greatest(F.col(f"{shard}_bytes"), F.lit(1)) / F.lit(FILE_BYTES))
    part = F.pmod(F.xxhash64(row), files)
    out = out.withColumn(row, part).withColumn(shard, F.concat(F.lit("b"), shard)).drop(f"{shard}_bytes", f"{shard}_rows")
    out.repartition(shard, row).drop(row).write.partitionBy(shard).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards under ``path``, columns of ``schema`` and the bits
    of their shard, taken from the folder's name."""
    shard = shard_column(spark.createDataFrame([], schema))
    back = spark.read.schema(T.StructType([*schema.fields, T.StructField(shard, T.StringType())])).parquet(path)
    return back.withColumn(shard, F.substring(shard, 2, KEY_BITS + ROW_BITS))


def sharded(docs: DataFrame, path: str, key: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the shards of ``docs`` and measure them where they lie: the rows of
    ``read_shards`` with ``bytes`` each, and bytes and rows of their shards."""
    if {"bytes", "shard", "shard_bytes", "shard_rows"} & {c.lower() for c in docs.columns}:
        raise ValueError("a column is called like a measure; rename it or use write_shards")
    write_shards(docs, path, key, row_bytes(docs), limit)
    rows = read_shards(docs.sparkSession, path, docs.schema).withColumn("bytes", row_bytes(docs))
    sizes = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return rows.join(sizes, "shard")


def oracle_sql(limit: int) -> str:
    """DuckDB SQL of the assignment of ``documents`` by doc_id."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, 16 + coalesce(octet_length(encode(text)), 0)
               + coalesce(octet_length(encode(lang)), 0) + coalesce(octet_length(encode(source)), 0) AS bytes,
             format('{{:060b}}', ('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 15))::BIGINT) AS bits FROM documents),
p AS (SELECT rid, bytes, left(bits, k) AS prefix, k FROM d, range(0, {KEY_BITS + 1}) t(k)),
b AS (SELECT prefix, k, sum(bytes) AS bytes, count(*) AS n FROM p GROUP BY prefix, k),
leaf AS (SELECT b.* FROM b LEFT JOIN b q ON q.k = b.k - 1 AND q.prefix = left(b.prefix, b.k - 1)
         WHERE (b.bytes <= {limit} OR b.n = 1) AND (b.k = 0 OR (q.bytes > {limit} AND q.n > 1)))
SELECT doc_id, prefix AS shard, CAST(leaf.k AS INTEGER) AS depth, CAST(d.bytes AS BIGINT) AS bytes, CAST(leaf.bytes AS BIGINT) AS shard_bytes,
       CAST(leaf.n AS BIGINT) AS shard_rows, leaf.bytes > {limit} AS oversized
FROM d JOIN p USING (rid) JOIN leaf USING (prefix, k)"""
