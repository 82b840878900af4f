"""Incremental ingest as streams."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.session import drop_at_exit, hadoop_path, shared_dir, written
from quillmark.sources.manifest import latest


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type, with a watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("v", 4).alias("v"))


def run_to_table(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there, in update mode: the watermark lets finished windows go, so the state stays bounded. Every batch writes what it changed
    into a folder of its own number, so a replayed batch writes the same again; of a key the latest batch counts."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    drop_at_exit(spark, root)
    return latest(spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out"), keys, "batch").drop("batch")


def apply_batch(target: str, batch: DataFrame, key: str, text: str, at: str, deleted: str, keep: int = 3, buckets: int = 64) -> None:
    """Merges a micro-batch into the table at `target`: rows whose content hash is unchanged are skipped, the latest row of a key wins, tombstones delete; a
    replayed batch changes nothing.

    The table is divided by key into `buckets` (chosen when it is made). Only buckets that the batch has keys of are read and written anew, beside the old ones;
    a version is a list of the folders that make it up, renamed into place in one step. The last `keep` versions stay, so that readers of the one before can finish."""
    spark = batch.sparkSession
    old = version(spark, target)
    n = old.buckets if old else buckets
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    new = written(latest(batch.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), [key], at, "hash"))
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # at most as many as there are buckets
    mine = [f"{target}/{old.folders[b]}" for b in touched if b in old.folders] if old else []
    if mine:
        now = spark.read.schema(old.schema).parquet(*mine)
        before = now.join(new.select(key, F.col(at).alias("_at"), F.col("hash").alias("_hash")), key, "left")
        stay = before.where(F.col("_at").isNull() | (F.col("_at") < F.col(at)) | ((F.col("_hash") == F.col("hash")) & F.col("_at").isNotNull())).drop("_at", "_hash")
        fresh = new.join(now.select(key, F.col("hash").alias("_hash"), F.col(at).alias("_at")), key, "left").where(F.col("_hash").isNull() | ((F.col("_hash") != F.col("hash")) & (F.col("_at") <= F.col(at))) | F.col(deleted).isNotNull()).drop("_hash", "_at")
        gone = fresh.where(F.col(deleted).isNotNull()).select(key)
        merged = stay.join(gone, key, "left_anti").join(fresh.select(key), key, "left_anti").unionByName(fresh.where(F.col(deleted).isNull()))
    else:
        merged = new.where(F.col(deleted).isNull())
    name = f"data/{uuid.uuid4().hex}"
    merged.withColumn("_bucket", bucket).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{target}/{name}")
    fs = hadoop_path(spark, target)[1]
    folders = {b: f for b, f in (old.folders if old else {}).items() if b not in touched}
    folders |= {b: f"{name}/_bucket={b}" for b in touched if fs.exists(hadoop_path(spark, f"{target}/{name}/_bucket={b}")[0])}
    _publish(spark, target, Version(old.number + 1 if old else 0, n, new.schema if old is None else old.schema, folders), keep)


@dataclass
class Version:
    """What a version is made up of: of each bucket that has rows its folder."""

    number: int
    buckets: int
    schema: StructType
    folders: dict[int, str]


def _publish(spark: SparkSession, target: str, new: Version, keep: int) -> None:
    lines = [json.dumps({"buckets": new.buckets, "schema": new.schema.json()}), *(json.dumps([b, f]) for b, f in sorted(new.folders.items()))]
    draft = f"{target}/_draft-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(draft)
    done, fs = hadoop_path(spark, f"{target}/v-{new.number:010d}")
    if not fs.rename(hadoop_path(spark, draft)[0], done):  # one step: readers see the old version or the new one
        raise RuntimeError(f"version {new.number} of {target} was published by another writer")
    names = versions(spark, target)
    kept = {f for v in names[-keep:] for f in version(spark, target, v).folders.values()}
    for v in names[:-keep]:
        for f in set(version(spark, target, v).folders.values()) - kept:
            fs.delete(hadoop_path(spark, f"{target}/{f}")[0], True)
        fs.delete(hadoop_path(spark, f"{target}/{v}")[0], True)


def version(spark: SparkSession, target: str, name: str | None = None) -> Version | None:
    """A version by name, or the latest; None before the first. Anything unreadable is an error: it must not pass for an empty table."""
    if name is None:
        names = versions(spark, target)
        if not names:
            return None
        name = names[-1]
    head, folders = None, {}
    for r in spark.read.text(f"{target}/{name}").collect():  # a line a bucket
        x = json.loads(r[0])
        if isinstance(x, dict):
            head = x
        else:
            folders[x[0]] = x[1]
    if head is None:
        raise ValueError(f"{target}/{name} is no version")
    return Version(int(name[2:]), head["buckets"], StructType.fromJson(json.loads(head["schema"])), folders)


def versions(spark: SparkSession, target: str) -> list[str]:
    """The complete versions, oldest first: v-<number> folders."""
    p, fs = hadoop_path(spark, target)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("v-"))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of the latest version, or None before the first."""
    v = version(spark, target)
    if v is None:
        return None
    return spark.read.schema(v.schema).parquet(*(f"{target}/{f}" for _, f in sorted(v.folders.items()))) if v.folders else spark.createDataFrame([], v.schema)
