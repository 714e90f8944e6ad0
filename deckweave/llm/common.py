"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckweave.session import cut as cut
from deckweave.session import shared_folder
from deckweave.sources.files import file_system as file_system


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """An object broadcast with its classes, opened once in each place it is used; its size must be bounded."""

    def __init__(self, spark: SparkSession, value: Any):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: Any = None

    def __getstate__(self) -> dict:
        return {"_held": self._held, "_value": None}

    @property
    def value(self) -> Any:
        if self._value is None:
            self._value = pickle.loads(self._held.value)
        return self._value


def least_by_hash(df: DataFrame, columns: list[str], most: int, spare: int = 50) -> list:
    """At most ``most`` distinct rows of some columns, those of the least hashes: a bounded sample to fit a model on.

    Which rows come into question is decided by their content's hash before
    anything moves, with ``spare`` times as many as are needed, so that many
    copies of some texts don't starve the sample and only a sliver is shuffled.
    """
    own = df.select(*columns)
    share = most * spare / max(own.count(), 1)
    mixed = F.xxhash64(*columns)
    if share < 1:
        own = own.where(F.pmod(mixed, F.lit(1 << 30)) < int(share * (1 << 30)))
    return own.distinct().orderBy(mixed, *columns).limit(most).collect()


def spread(df: DataFrame) -> DataFrame:
    """A scan that Python works on, in at least as many partitions as there are cores; larger inputs have them anyway and don't move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def written(df: DataFrame, by: Sequence[str]) -> str:
    """Where ``df`` was written in the shared folder, in a folder for each value of ``by``, for tasks to read it from."""
    path = f"{shared_folder(df.sparkSession)}/deckweave-{uuid.uuid4().hex}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], spread_by: Column, salts: Column) -> DataFrame:
    """``many`` left joined with ``few`` (one row a key), a key's rows spread over ``salts`` tasks, so that a hot key isn't one task's.

    ``spread_by`` is an integer of ``many``; ``salts`` reads only columns of ``on``, since both sides must agree on it.
    """
    left = many.withColumn("_salt", F.pmod(spread_by, salts.cast("bigint")).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


def read_rows(path: str, columns: Sequence[str]) -> Iterator[tuple]:
    """Rows of a written folder, read by a task; none where the folder isn't there."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = file_system(path)
    for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                own = pq.ParquetFile(f).read(list(columns))
            yield from zip(*(own.column(c).to_pylist() for c in columns))
