"""Reports over the artifacts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` without an artifact."""
    return wanted.join(there.select(key).distinct(), key, "left_anti")


def existing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` with an artifact."""
    return wanted.join(there.select(key).distinct(), key, "left_semi")


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """The rows of the first table that has any, in one plan: the tables are united with their place and the least place is kept."""
    numbered = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    all_ = numbered[0]
    for t in numbered[1:]:
        all_ = all_.unionByName(t, allowMissingColumns=True)
    least = all_.agg(F.min("tier").alias("tier"))
    return all_.join(F.broadcast(least), "tier")  # one row


def verify(records: DataFrame, group: str) -> DataFrame:
    """(group, modules, pdfs, jsons, translated, ok) with a total row (group null): ok where every module has a pdf and every pdf a json; the total is ok if all groups are."""
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    by = records.groupBy(group).agg(F.count("*").alias("modules"), has("cached_path").alias("pdfs"), has("json_path").alias("jsons"), has("translated_path").alias("translated"))
    by = by.withColumn("ok", (F.col("pdfs") >= F.col("modules")) & (F.col("jsons") >= F.col("pdfs")))
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("modules", "pdfs", "jsons", "translated")]
    return by.rollup(group).agg(*sums, F.bool_and("ok").alias("ok"))  # the groups once more and all of them together


def relative(path: Column, folder: Column) -> Column:
    """A path below a folder; empty for none."""
    inside = F.concat(folder, F.lit("/"))
    return F.coalesce(F.when(path.startswith(inside), F.substr(path, F.length(inside) + 1)).otherwise(path), F.lit(""))


def manifest_records(records: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """(keys..., record): each module's JSON record, without what is null or empty; a manifest as lines, whatever a course's size."""
    kept = [F.when(c.cast("string") != "", c).alias(name) for name, c in fields.items()]
    return records.select(*keys, F.to_json(F.struct(*kept)).alias("record"))


def manifest(records: DataFrame, course: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """(course, files, manifest): a JSON list of each course's modules in order.

    A whole course is one row and so one task's: for small courses that want a
    single file; ``manifest_records`` has no such bound.
    """
    own = manifest_records(records, list(dict.fromkeys([course, *order])), fields)
    own = own.groupBy(course).agg(F.sort_array(F.collect_list(F.struct(*order, "record"))).alias("all"))
    return own.select(course, F.size("all").cast("bigint").alias("files"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["record"]), ","), F.lit("]")).alias("manifest"))


def log_tally(lines: DataFrame, line: str = "line") -> DataFrame:
    """(ok, failed): lines that report a success and lines that report a failure."""
    return lines.agg(F.count_if(F.col(line).startswith("OK ")).alias("ok"), F.count_if(F.col(line).startswith("FAIL ")).alias("failed"))


def unkept(names: DataFrame, keep: list[str], name: str = "name") -> DataFrame:
    """Entries of a folder that aren't kept."""
    spark = names.sparkSession
    return names.select(name).exceptAll(spark.createDataFrame([(k,) for k in keep], f"{name} string"))


def prune(spark: SparkSession, folder: str, keep: list[str]) -> int:
    """Deletes the files, not the folders, of a folder that aren't kept; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    if system.exists(path):
        for entry in system.listStatus(path):
            if entry.isFile() and entry.getPath().getName() not in keep:
                gone += bool(system.delete(entry.getPath(), False))
    return gone


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The table and what will be known of it once it is written: its rows and some counts, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())), seen
