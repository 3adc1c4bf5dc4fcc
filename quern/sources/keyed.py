"""A keyed store on Parquet: files that each hold a range of keys, upserts that rewrite the ranges they hit, and a Python data source.

A table's folder has ``data`` (files) and ``manifest`` (a small table for each version: a file, its range of keys, its rows).
A version is there once its manifest is complete; readers take the last one, and files of older versions stay until ``vacuum``.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from quern.operators import store


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS")))


def _files(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows (file, low, high, rows, batch) of a version's manifest, by key: as many as the table has files."""
    versions = _versions(spark, path)
    if not versions:
        return []
    return spark.read.parquet(f"{path}/manifest/v{versions[-1] if version is None else version}").filter("rows > 0").orderBy("low").collect()


def _commit(spark: SparkSession, path: str, kept: DataFrame | None, made: str | None, key: str, batch: int) -> None:
    parts = [] if kept is None else [kept]
    if made:
        parts.append(spark.read.parquet(made).groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows")))
    manifest = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    versions = _versions(spark, path)
    manifest.withColumn("batch", F.lit(batch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{versions[-1] + 1 if versions else 0}")


def _write_data(df: DataFrame, path: str, key: str, ranges: int) -> str:
    made = f"{path}/data/{uuid.uuid4().hex}"
    df.repartitionByRange(ranges, key).sortWithinPartitions(key).write.parquet(made)
    return made


def write_keyed(df: DataFrame, path: str, key: str, ranges: int = 8, batch: int = -1) -> None:
    """A new version with all rows of ``df``: files that each hold a range of keys, sorted; together they cover all keys."""
    _commit(df.sparkSession, path, None, _write_data(df, path, key, ranges), key, batch)


def latest(new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``, a column that says which of a key's rows came later."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return new.withColumn("__k", rank).filter("__k = 1").drop("__k")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` rows in place of ``old`` ones with their key; of new rows with one key the last by ``order``, which isn't kept unless ``old`` has it."""
    last = latest(new, key, order)
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, order: str, batch: int = -1) -> None:
    """A new version in which ``new`` rows replace those with their key; only files whose range of keys is hit are rewritten."""
    files = _files(spark, path)
    if not files:
        return write_keyed(latest(new, key, order), path, key, batch=batch)
    if batch >= 0 and files[0]["batch"] >= batch:  # this micro-batch has come before
        return None
    lows = [f["low"] for f in files]

    @F.pandas_udf("int")
    def file_of(keys: pd.Series) -> pd.Series:
        import bisect

        return keys.map(lambda k: max(bisect.bisect_right(lows, k) - 1, 0)).astype("int32")

    hit = sorted(r[0] for r in new.filter(F.col(key).isNotNull()).select(file_of(key)).distinct().collect())
    if not hit:
        return None
    old = spark.read.parquet(*(files[k]["file"] for k in hit))
    made = _write_data(upserted(old, new.filter(F.col(key).isNotNull()), key, order), path, key, len(hit))
    rest = [(files[k]["file"],) for k in range(len(files)) if k not in set(hit)]
    now = spark.read.parquet(f"{path}/manifest/v{_versions(spark, path)[-1]}").drop("batch")
    _commit(spark, path, now.join(F.broadcast(spark.createDataFrame(rest, "file string")), "file", "left_semi"), made, key, batch)
    return None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the last ``keep`` versions, and the data folders that none of those names; gives the number of folders."""
    versions = _versions(spark, path)
    named = {f["file"].rsplit("/", 2)[-2] for v in versions[-keep:] for f in _files(spark, path, v)}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for v in versions[:-keep]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/v{v}"), True)
    gone = [s.getPath() for s in system.listStatus(root) if s.getPath().getName() not in named]
    return sum(bool(system.delete(p, True)) for p in gone)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The last version by Spark's own scan."""
    return spark.read.parquet(*(f["file"] for f in _files(spark, path)))


def scan(spark: SparkSession, path: str, key: str, columns: list[str] | None = None, condition: Column | str | None = None) -> DataFrame:
    """The last version through the data source: files by ``condition``, and of them only ``columns`` and what the condition needs is read."""
    register(spark)
    source = spark.read.format("quern_keyed").option("path", path).option("key", key)
    whole = source.load()
    if columns is None:
        return whole if condition is None else whole.filter(condition)
    asked = whole.select(*columns) if condition is None else whole.filter(condition).select(*columns)
    needed = {a.lower() for a in _references(asked)} | {c.lower() for c in columns}
    pruned = source.schema(StructType([f for f in whole.schema if f.name.lower() in needed])).load()
    return (pruned if condition is None else pruned.filter(condition)).select(*columns)


def _references(df: DataFrame) -> list[str]:
    """Names of all columns that a plan's expressions use."""
    plan, out, todo = df._jdf.queryExecution().optimizedPlan(), [], []
    todo.append(plan)
    while todo:
        node = todo.pop()
        found = node.references().toSeq()
        out += [found.apply(k).name() for k in range(found.size())]
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


# -- what a table's properties say


def column_mapping(text: str, columns: list[str]) -> list[tuple[str, str, str]]:
    """``:key,f:a,f:b`` as (family, qualifier, column); the key has no family."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) > len(columns) or any(":" not in p for p in parts):
        raise ValueError(f"{text} doesn't map the columns {', '.join(columns)}")
    return [(*p.split(":", 1), c) for p, c in zip(parts, columns, strict=False)]


def keyed_table(spark: SparkSession, table: str) -> tuple[str, str]:
    """The key's column and function of a table, by its properties."""
    own = store.properties(spark, table)
    if store.COLUMNS_MAPPING not in own or store.ROWKEY_FUNCTION not in own:
        raise store.AnalysisError(f"{table} has no properties {store.COLUMNS_MAPPING} and {store.ROWKEY_FUNCTION}")
    mapping = column_mapping(own[store.COLUMNS_MAPPING], spark.table(store.plain(table)).columns)
    return next(c for family, qualifier, c in mapping if not family and qualifier == "key"), own[store.ROWKEY_FUNCTION]


# -- the data source


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _system(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _manifest(path: str) -> list[dict]:
    """The last version's files: one small table, whatever the number and size of the files."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, root = _system(f"{path}/manifest")
    complete = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.base_name == "_SUCCESS"]
    if not complete:
        raise ValueError(f"{path} has no keyed table")
    last = max((p.rsplit("/", 1)[0] for p in complete), key=lambda p: int(p.rsplit("/v", 1)[1]))
    parts = [i.path for i in system.get_file_info(fs.FileSelector(last)) if i.path.endswith(".parquet")]
    return [r for p in parts for r in pq.read_table(system.open_input_file(p)).to_pylist() if r["rows"]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType):
        self.path, self.key, self.schema = path, key, schema
        self.low = self.high = self.among = None

    def pushFilters(self, filters):
        """Filters on the key bound the files and row groups that are read; all are given back, as rows are still to be filtered."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                if isinstance(f, EqualTo):
                    self._bound(f.value, f.value)
                elif isinstance(f, StringStartsWith):
                    self._bound(f.value, f.value + "\U0010ffff")
                elif isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                    self._bound(f.value, None)
                elif isinstance(f, (LessThanOrEqual, LessThan)):
                    self._bound(None, f.value)
                elif isinstance(f, In):
                    own = {v for v in f.value if v is not None}
                    self.among = own if self.among is None else self.among & own
            yield f

    def _bound(self, low, high) -> None:
        self.low = low if self.low is None else self.low if low is None else max(low, self.low)
        self.high = high if self.high is None else self.high if high is None else min(high, self.high)

    def _holds(self, low, high) -> bool:
        return (self.low is None or high >= self.low) and (self.high is None or low <= self.high) and (self.among is None or any(low <= v <= high for v in self.among))

    def partitions(self):
        return [_File(r["file"]) for r in _manifest(self.path) if self._holds(r["low"], r["high"])] or [_File("")]

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition.value:
            system, path = _system(partition.value)
            bounds = [(self.key, ">=", self.low)] * (self.low is not None) + [(self.key, "<=", self.high)] * (self.high is not None)
            yield from pq.read_table(path, filesystem=system, columns=self.schema.names, filters=bounds or None).to_batches()


class KeyedSource(DataSource):
    """``format("quern_keyed")`` with options path and key; a schema that is given names the columns to read."""

    REQUIRED = ("path", "key")

    def __init__(self, options):
        super().__init__(options)
        for name in self.REQUIRED:
            if not options.get(name):
                raise ValueError(f"option {name} is missing")

    @classmethod
    def name(cls) -> str:
        return "quern_keyed"

    def schema(self) -> str | StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _manifest(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no rows")
        system, path = _system(files[0]["file"])
        return from_arrow_schema(pq.read_schema(system.open_input_file(path)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["key"], schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedSource)
