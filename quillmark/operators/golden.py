"""Golden question sets: checks, triage, slices and samples, all deterministic by SHA-256 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import written


def hash_order(seed: str, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *keys), 256)


def balanced(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows (all, if fewer), strata in proportion by largest remainder (ties: the stratum's name), rows by hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("all"))
    q = sizes.crossJoin(F.broadcast(total)).withColumn("exact", F.least(F.lit(n), F.col("all")) * F.col("c") / F.col("all"))  # one row
    q = q.withColumn("base", F.floor("exact")).withColumn("frac", F.round(F.col("exact") - F.col("base"), 9))
    one = F.lit(1)
    rest = F.least(F.lit(n), F.col("all")) - F.sum("base").over(Window.partitionBy(one))
    q = q.withColumn("rest", rest).withColumn("place", F.row_number().over(Window.partitionBy(one).orderBy(F.desc("frac"), F.col(stratum))))
    quota = q.select(stratum, (F.col("base") + (F.col("place") <= F.col("rest")).cast("int")).alias("quota"))
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key))))
    return rows.join(quota, stratum).where("rn <= quota").drop("rn", "quota")


def anchored_sample(universe: DataFrame, gold: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """All gold rows and others in hash order up to round(fraction * N) rows; `gold` says which a row is."""
    g = universe.join(gold.select(key).distinct(), key, "left_semi").select(key, F.lit(True).alias("gold"))
    others = universe.select(key).join(gold.select(key), key, "left_anti").withColumn("hash", hash_order(seed, key))
    rest = universe.agg(F.floor(F.count("*") * fraction + 0.5).alias("target")).crossJoin(g.agg(F.count("*").alias("have")))  # single rows
    rest = rest.select(F.greatest(F.lit(0), F.col("target") - F.col("have")).alias("rest"))
    return g.unionByName(first_by_hash(others, "hash", rest).select(key, F.lit(False).alias("gold")))


def first_by_hash(df: DataFrame, hash_: str, rest: DataFrame, digits: int = 4) -> DataFrame:
    """The `rest` (a single row) first rows in the order of a hexadecimal hash, exactly: whole buckets by the hash's first digits (16^digits of them at most),
    and of the bucket that the boundary falls into the first ones. No task orders more than a bucket."""
    d = df.withColumn("bucket", F.substring(hash_, 1, digits))
    sizes = d.groupBy("bucket").agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).crossJoin(F.broadcast(rest)).where("before < rest")
    near = d.join(F.broadcast(sizes), "bucket")  # at most 16^digits rows
    whole = near.where("before + c <= rest")
    part = near.where("before + c > rest").withColumn("_rn", F.row_number().over(Window.partitionBy("bucket").orderBy(hash_))).where("before + _rn <= rest")
    return whole.select(df.columns).unionByName(part.select(df.columns))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df as a written table with `rn`, its rows' numbers from 1 in the order of `order` (a key): ranges are sorted in their tasks and numbered by offsets, so
    that no task holds more than its range, whatever the keys look like."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("c"))  # a row a range
    w = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("off"))
    return ranged.join(F.broadcast(offs), "_part").withColumn("rn", F.col("_i") + F.col("off") + 1).drop("_part", "_i", "off")


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every step-th row in order, step = N // n (at least 1), at most n rows."""
    rows = numbered(df, order)
    total = F.broadcast(rows.agg(F.count("*").alias("all")))  # a single row
    step = F.greatest(F.lit(1), F.floor(F.col("all") / n))
    return rows.crossJoin(total).where((F.col("rn") - 1) % step == 0).where((F.col("rn") - 1) / step < n).drop("all")


def following(df: DataFrame, group: str, order: str, value: str, n: int, name: str) -> DataFrame:
    """Adds to each row the array `name` of its own and the next n - 1 values of its group, in order. Rows are numbered over all groups and each gives its value
    to the rows before it, so that a large group is no single task."""
    rows = numbered(df, group, order)
    give = rows.select(F.col(group).alias("_g"), F.explode(F.sequence(F.col("rn") - n + 1, F.col("rn"))).alias("_to"), F.struct(F.col("rn").alias("rn"), F.col(value).alias("v")).alias("x"))
    got = give.groupBy("_g", "_to").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(name))  # at most n
    return rows.join(got, (F.col(group) == F.col("_g")) & (F.col("rn") == F.col("_to"))).drop("_g", "_to", "rn")


def expanded(df: DataFrame, stratum: str, key: str, drawn: Column, good: Column, n: int, over: float, seed: str) -> DataFrame:
    """(key, stratum): about n of the drawn rows in the mix of the others: of each stratum `over` times its part is taken in hash order, those that are not good are
    dropped, and what is left is cut to its part."""
    mix = df.where(~drawn).groupBy(stratum).agg(F.count("*").alias("c"))
    all_ = F.broadcast(mix.agg(F.sum("c").alias("all")))  # a single row
    part = mix.crossJoin(all_).select(stratum, F.floor(n * F.col("c") / F.col("all") + 0.5).alias("want"))
    rows = df.where(drawn).withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key))))
    kept = rows.join(F.broadcast(part), stratum).where(F.col("rn") <= F.ceil(over * F.col("want"))).where(good)  # a row a stratum
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(stratum).orderBy("rn"))).where("n <= want").select(key, stratum)
