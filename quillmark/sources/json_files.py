"""JSON files: scans of arrays or lines, sinks of lines, and single result files."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.session import hadoop_path


def scan(spark: SparkSession, path: str, schema: StructType | str, lines: bool = True) -> DataFrame:
    """Records of JSON files: one a line (splittable, for any size) or, with lines=False, arrays over several lines (a file is a task). Fields that the schema does
    not name are left out, missing ones are null, and a malformed record is an error."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def parents(df: DataFrame) -> DataFrame:
    """Sections with their composite key."""
    return df.withColumn("parent_id", F.concat_ws("#", "source", "section_idx"))


def write(df: DataFrame, path: str) -> None:
    """One record a line, nulls kept as fields, in as many files as df has partitions; what was there is replaced when the job commits."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def write_result(df: DataFrame, folder: str, retriever: str, meta: dict, stamp: str | None = None, most: int = 1_000_000) -> str:
    """One file <retriever>_<stamp>.json with `meta` and the rows of a report, whose number is checked; written beside and renamed."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is a table: use write()")
    spark = df.sparkSession
    name = f"{folder}/{retriever}_{stamp or time.strftime('%Y%m%d-%H%M%S')}.json"
    draft, fs = hadoop_path(spark, f"{name}.part")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({**meta, "rows": rows}, ensure_ascii=False, default=str, indent=1).encode()))
    finally:
        out.close()
    done = hadoop_path(spark, name)[0]
    fs.delete(done, False)
    if not fs.rename(draft, done):
        raise OSError(f"could not write {name}")
    return name


def settings(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a local file; comments and quotes are left off."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                out[key.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out
