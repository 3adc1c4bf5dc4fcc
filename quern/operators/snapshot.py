"""MAKE SNAPSHOT and RESTORE: copies of tables or of some of their partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators import store
from quern.operators.store import Storage
from quern.operators.update import partition_condition
from quern.plans.statements import MakeSnapshot, Restore


def rows(spark: SparkSession, s: MakeSnapshot) -> DataFrame:
    table = spark.table(store.plain(s.source))
    return table.filter(partition_condition(spark, s.source, s.partitions)) if s.partitions else table


def make(spark: SparkSession, s: MakeSnapshot) -> DataFrame:
    """Creates the snapshot (an error if it exists) and returns an empty result.

    A keyed store's snapshot is a whole, immutable copy of its table whatever the specs say.
    """
    keyed = not store.is_view(spark, s.source) and store.storage(spark, s.source) is Storage.HBASE
    df = spark.table(store.plain(s.source)) if keyed else rows(spark, s)
    path = f"file:{s.directory}" if s.local and s.directory and ":" not in s.directory else s.directory
    store.save_new(df, s.target, s.source, path)
    spark.sql(f"ALTER TABLE {s.target} SET TBLPROPERTIES ('quern.snapshot.of' = '{store.plain(s.source)}')")
    return spark.createDataFrame([], df.schema)


def restore(spark: SparkSession, s: Restore) -> DataFrame:
    store.swap(spark.table(store.plain(s.snapshot)), s.target)
    return spark.table(store.plain(s.target))
