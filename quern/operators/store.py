"""Tables as they are stored: their kind, partition columns and provider, and replacing one as a whole.

Spark's file tables can't be updated in place, so a new version is written beside the table and two renames put it in
place; the old version stays as a backup that RESTORE can bring back.
"""

from __future__ import annotations

import re
import time
import uuid
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Table properties by name (fixed values).
STORAGE_TYPE = "spark.dialect.storage.type"
ROWKEY_FIRST = "spark.dialect.hbase.table.rowkey.fields.first"
COLUMNS_MAPPING = "spark.dialect.hbase.columns.mapping"
ROWKEY_FUNCTION = "spark.dialect.hbase.table.rowkey.func"


#: What staged tables are named, whole ones and those of partitions, and their notes.
STAGED, PARTIAL, REPLACES, BACKUP = "__stage_", "__part_", "quern.replaces", "quern.backup"


class AnalysisError(ValueError):
    pass


class Storage(Enum):
    HIVE, HBASE, ES, SOLR, ORACLE, REDIS, MYSQL = "hive", "hbase", "es", "solr", "oracle", "redis", "mysql"


def plain(name: str) -> str:
    return name.replace("`", "")


def is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.getTable(plain(table)).tableType in ("TEMPORARY", "VIEW")


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    if is_view(spark, table):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def storage(spark: SparkSession, table: str) -> Storage:
    return Storage(properties(spark, table).get(STORAGE_TYPE, "hive"))


def indexed(spark: SparkSession, table: str) -> bool:
    """Whether rows of the table are found by key: its updates then touch matched rows only."""
    kind, own = storage(spark, table), properties(spark, table)
    return kind in (Storage.ES, Storage.SOLR) or kind is Storage.HBASE and ROWKEY_FIRST in own


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(plain(table)) if c.isPartition]


def described(spark: SparkSession, table: str) -> dict[str, str]:
    """The detailed rows of a table's description by name (Provider, Type, Location, Comment, ...)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    start = next((k for k, r in enumerate(rows) if r["col_name"].startswith("# Detailed")), len(rows))
    return {r["col_name"]: r["data_type"] for r in rows[start + 1 :]}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def save_new(df: DataFrame, table: str, like: str, path: str | None = None) -> None:
    """Creates ``table`` with provider, partitions, buckets and comments of ``like``, and ``df`` as its rows; fails if it exists."""
    spark = df.sparkSession
    if is_view(spark, like):
        writer = df.write.mode("error")
        (writer.option("path", path) if path else writer).saveAsTable(plain(table))
        return
    own = described(spark, like)
    spark.sql(f"CREATE TABLE {table} LIKE {like} USING {own.get('Provider', 'parquet')}" + (f" LOCATION {_text(path)}" if path else ""))
    if own.get("Comment"):
        spark.sql(f"COMMENT ON TABLE {table} IS {_text(own['Comment'])}")
    try:
        df.select(*spark.table(plain(table)).columns).write.insertInto(plain(table))
    except Exception:
        spark.sql(f"DROP TABLE {table}")
        raise


def rename(spark: SparkSession, table: str, name: str) -> None:
    """A rename moves a managed table's files; one statement then looks up where its partitions lie."""
    spark.sql(f"ALTER TABLE {table} RENAME TO {name}")
    if partition_columns(spark, name) and described(spark, name).get("Type") == "MANAGED":
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(plain(name))


def swap(df: DataFrame, table: str) -> str | None:
    """Puts ``df`` in place of a table and returns the backup's name; a view is replaced by a view of ``df``.

    A table outside the warehouse stays one: its new version lies beside the old one's folder.
    """
    spark = df.sparkSession
    if is_view(spark, table):
        df.createOrReplaceTempView(plain(table))
        return None
    kept = {k: v for k, v in properties(spark, table).items() if k not in (REPLACES, BACKUP) and not k.startswith(("transient", "spark.sql."))}
    tag, own = uuid.uuid4().hex[:8], described(spark, table)
    staged, backup = f"{plain(table)}{STAGED}{tag}", f"{plain(table)}__backup_{int(time.time() * 1000)}"
    save_new(df, staged, table, f"{own['Location'].rstrip('/')}__{tag}" if own.get("Type") == "EXTERNAL" else None)
    # the note says that the staged table is whole, and which names belong together if a rename doesn't come
    note = {**kept, REPLACES: plain(table), BACKUP: backup}
    spark.sql(f"ALTER TABLE {staged} SET TBLPROPERTIES ({', '.join(f'{_text(k)} = {_text(v)}' for k, v in note.items())})")
    rename(spark, table, backup)
    rename(spark, staged, plain(table))
    return backup


def recover(spark: SparkSession, table: str) -> str:
    """Ends a swap or a rewrite of partitions that broke off: ``finished`` (the new version is in place now), ``undone`` (the old one stays, the rest is gone) or ``whole``."""
    name = plain(table)
    database, _, last = name.rpartition(".")
    left = [t.name for t in spark.catalog.listTables(*([database] if database else [])) if t.name.startswith((f"{last}{STAGED}".lower(), f"{last}{PARTIAL}".lower()))]
    out = "whole"
    for staged in (f"{database}.{t}" if database else t for t in left):
        if not spark.catalog.tableExists(name) and properties(spark, staged).get(REPLACES, "").lower() == name.lower():
            rename(spark, staged, name)
            out = "finished"
        else:
            spark.sql(f"DROP TABLE {staged}")
            out = "undone" if out == "whole" else out
    return out


def replace_partitions(df: DataFrame, table: str) -> None:
    """Rewrites the partitions that ``df`` has rows of, and no others; ``df`` may read the table."""
    spark, staged = df.sparkSession, f"{plain(table)}{PARTIAL}{uuid.uuid4().hex[:8]}"
    save_new(df, staged, table)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode, None)
    spark.conf.set(mode, "dynamic")
    try:
        spark.table(staged).write.mode("overwrite").insertInto(plain(table))
    finally:
        spark.conf.unset(mode) if before is None else spark.conf.set(mode, before)
    spark.sql(f"DROP TABLE {staged}")
    spark.catalog.refreshTable(plain(table))


def load(spark: SparkSession, path: str, table: str, overwrite: bool = False, partition=()) -> DataFrame:
    """Copies files that are written as a table's are into it, or into the partition named; the files stay where they are."""
    own, parts = described(spark, table), dict(partition)
    schema = StructType([f for f in spark.table(plain(table)).schema if f.name.lower() not in {k.lower() for k in parts}])
    reader = spark.read.format(own.get("Provider", "parquet")).schema(schema)
    stored = re.findall(r"([^\[,=]+)=([^\],]*|,)(?=[\],])", own.get("Storage Properties", ""))
    view = f"__load_{uuid.uuid4().hex[:8]}"
    reader.options(**{k.strip(): v for k, v in stored if k.strip() != "path"}).load(path).createOrReplaceTempView(view)
    into = f" PARTITION ({', '.join(f'`{k}` = {_text(v)}' for k, v in partition)})" if parts else ""
    spark.sql(f"INSERT {'OVERWRITE' if overwrite else 'INTO'} TABLE {table}{into} SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return spark.createDataFrame([], schema)
