"""Sharding along a Hilbert curve: several metadata dimensions are quantised, rows sorted by their index on the curve, and the order is
cut into runs, so that min/max statistics of a shard are narrow in all dimensions at once.

DataFrame functions only. The plan:
1. one scan of the documents keeps ids, sizes, checksums and the dimensions as numbers (some 60 bytes a row, written once);
2. one aggregate finds the cut points of each dimension (mergeable quantile sketches: 2**BITS - 1 numbers a dimension, whatever the input);
3. the rows are range-partitioned by curve index, checksum and id. The id makes the key unique, so a source or a text with a third of
   all rows is spread like any other;
4. the place of a row is the number of rows in the partitions before its own plus its place there: no task sees more than one partition,
   and one number per partition is all that is brought together.
The law is `rows`: of n rows, shard s takes those at places ceil(s*n/shards) to ceil((s+1)*n/shards)-1, so counts are at most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed

BITS = 6
#: Bytes of a string that its place in a dimension depends on.
PREFIX = 7


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def string_place(column: str) -> Column:
    """The first bytes of a string as a number in the order of the strings; null comes first, as -1."""
    digits = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, PREFIX)), 2 * PREFIX, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


def cut_points(df: DataFrame, dimensions: list[str]) -> list[list[int]]:
    """Quantiles of each dimension, repeated where one value has much of the rows, so that codes follow the mass; none for an empty table."""
    shares = F.array(*(F.lit(k / 2 ** BITS) for k in range(1, 2 ** BITS)))
    row = df.agg(*(F.percentile_approx(d, shares, 10_000).alias(d) for d in dimensions)).first()
    return [sorted(row[d] or []) for d in dimensions]


def quantise(value: Column, cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < value))


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the curve of a cell whose coordinates have `bits` bits each."""
    n = len(axes)
    names = [f"x{i}" for i in range(n)]

    def turn(state: Column, q: Column) -> Column:
        low, x = q - F.lit(1), [state[name] for name in names]
        x[0] = x[0].bitwiseXOR(F.when(x[0].bitwiseAND(q) != 0, low).otherwise(F.lit(0)))
        for i in range(1, n):
            high = x[i].bitwiseAND(q) != 0
            swap = F.when(high, F.lit(0)).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(low))
            x[0] = x[0].bitwiseXOR(F.when(high, low).otherwise(swap))
            x[i] = x[i].bitwiseXOR(swap)
        return F.struct(*(c.alias(name) for c, name in zip(x, names)))

    powers = [2 ** b for b in range(bits - 1, 0, -1)]
    start = F.struct(*(a.cast("int").alias(name) for a, name in zip(axes, names)))

    def gray(state: Column) -> Column:
        x = [state[name] for name in names]
        for i in range(1, n):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        flip = reduce(lambda t, q: t.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0))), powers, F.lit(0))
        done = F.struct(*(c.bitwiseXOR(flip).cast("long").alias(name) for c, name in zip(x, names)))
        return F.aggregate(F.array(done), F.lit(0).cast("long"), lambda _, s: interleave([s[name] for name in names]))

    def interleave(x: list[Column]) -> Column:
        terms = [F.shiftleft(F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i) for b in range(bits) for i in range(n)]
        return reduce(lambda a, b: a.bitwiseOR(b), terms)

    return F.aggregate(F.array(*(F.lit(q) for q in powers)), start, turn, gray)


def shard_rows(rows: DataFrame, dimensions: list[str], shards: int, tie: list[str]) -> DataFrame:
    """rows with `hilbert`, `shard` and `slot`.

    dimensions are long columns of rows, tie columns that order the rows of a cell. An empty table stays empty; with fewer
    rows than shards some shards stay empty. Equal rows take neighbouring places in any order.
    """
    spark = rows.sparkSession
    cuts = cut_points(rows, dimensions)
    placed = rows.withColumn("hilbert", hilbert_index([quantise(F.col(d), c) for d, c in zip(dimensions, cuts)]))
    order = ["hilbert", *tie]
    ordered = checkpointed(placed.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    sizes = numbered.groupBy(F.shiftright("_id", 33).alias("part")).count().orderBy("part").collect()  # a number per partition
    total, before = 0, []
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.expr(f"(_place * {shards}) div {max(1, total)}")
    return (numbered.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_part"))
            .withColumn("_place", place).withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("_place") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
            .drop("_id", "_part", "_before", "_place"))


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", strings: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard for every row.

    The dimensions are the columns named in `strings` and the size. size is the UTF-8 bytes of the text plus 16; a null text has none
    and the checksum of an empty one. Nulls of a dimension sort first. Equal texts of one cell are neighbours. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = checkpointed(docs.select(
        F.col(key), (text_bytes(text) + 16).alias("size"), F.crc32(body).alias("text_crc32"),
        *(string_place(c).alias(f"_d{i}") for i, c in enumerate(strings))))
    out = shard_rows(rows, [*(f"_d{i}" for i in range(len(strings))), "size"], shards, ["text_crc32", key])
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """The documents as one folder of Parquet per shard, rows in the order of their slots, so that row groups prune too."""
    (docs.join(assigned.select(key, "shard", "slot"), key).repartition("shard").sortWithinPartitions("shard", "slot").drop("slot")
     .write.partitionBy("shard").parquet(path))
