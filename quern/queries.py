"""The catalogue: dialect statements and the delegated SQL surface as queries over the standard tables, with their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.engine import Engine
from quern.functions import models
from quern.functions import vectors as functions
from quern.operators import store
from quern.plans import rowkey
from quern.sources import arrow, jdbc, keyed
from quern.streaming import events as streams

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The session and folder whose tables are registered as views, and the engine over them.
_registered: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    at = (spark._jsparkSession.sessionUUID(), sf_dir)
    if at not in _registered:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        _registered.clear()
        _registered[at] = Engine(spark)
    return _registered[at]


def _query(name: str, oracle: str | None = None):
    def add(f: Callable[[Engine, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    _query(name, oracle or text)(lambda e, _: e.sql(text))


def _fresh(name: str) -> str:
    return f"q_{name}_{uuid.uuid4().hex[:8]}"


# -- UPDATE

TOTALS = "(SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total, max(o_orderpriority) AS seg FROM orders GROUP BY o_custkey) tm"
FLAGSHIP = f"UPDATE customer SET c_acctbal = round(tm.total / 7, 2), c_mktsegment = upper(substring(tm.seg, 3)) FROM {TOTALS} WHERE customer.c_custkey = tm.k"
_CUSTOMER = "c_custkey, c_name, c_nationkey"


def _update(name: str, statement: str, columns: str, oracle: str) -> None:
    _query(name, oracle)(lambda e, _: e.sql(statement).selectExpr(*columns.split("; ")))


_update("upd_subquery_from", FLAGSHIP, "c_custkey; c_name; round(c_acctbal, 2) AS c_acctbal; c_mktsegment; k__t; src_c_mktsegment", f"SELECT c_custkey, c_name, round(round(tm.total / 7, 2), 2) AS c_acctbal, upper(substring(tm.seg, 3)) AS c_mktsegment, k AS k__t, c_mktsegment AS src_c_mktsegment FROM customer, {TOTALS} WHERE c_custkey = tm.k")
_update("upd_table_from", "UPDATE supplier SET s_acctbal = 100 - nation.n_nationkey, s_name = reverse(nation.n_name) FROM nation WHERE supplier.s_nationkey = nation.n_nationkey", "s_suppkey; s_name; s_acctbal; src_s_name; n_name__t", "SELECT s_suppkey, reverse(n_name) AS s_name, (100 - n_nationkey)::DOUBLE AS s_acctbal, s_name AS src_s_name, n_name AS n_name__t FROM supplier, nation WHERE s_nationkey = n_nationkey")
_update("upd_alias_from", "UPDATE customer SET c_mktsegment = n.n_name FROM nation n WHERE customer.c_nationkey = n.n_nationkey AND n.n_regionkey = 1", "c_custkey; c_mktsegment", "SELECT c_custkey, n_name AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
_update("upd_join_from", "UPDATE customer SET c_mktsegment = r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE customer.c_nationkey = n.n_nationkey", "c_custkey; c_mktsegment", "SELECT c_custkey, r_name AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_update("upd_comma_from", "UPDATE customer SET c_mktsegment = r.r_name FROM nation n, region r WHERE customer.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey", "c_custkey; c_mktsegment", ORACLES["upd_join_from"])
_update("upd_self_ref_set", "UPDATE supplier SET s_acctbal = s_nationkey, s_nationkey = s_nationkey + n.n_regionkey FROM nation n WHERE s_nationkey = n.n_nationkey", "s_suppkey; s_acctbal; s_nationkey", "SELECT s_suppkey, s_nationkey::DOUBLE AS s_acctbal, s_nationkey + n_regionkey AS s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_update("upd_expr_key", "UPDATE customer SET c_name = s.s_name FROM supplier s WHERE c_custkey = s.s_suppkey AND c_name = concat(c_name, '')", "c_custkey; c_name", "SELECT c_custkey, s_name AS c_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
_update("upd_theta", "UPDATE nation SET n_name = r.r_name FROM region r WHERE nation.n_regionkey < r.r_regionkey", "n_nationkey; n_name", "SELECT n_nationkey, r_name AS n_name FROM nation JOIN region ON n_regionkey < r_regionkey")
_update("upd_multi_match", "UPDATE customer SET c_acctbal = o.o_totalprice FROM orders o WHERE c_custkey = o.o_custkey", "c_custkey; c_acctbal; o_orderkey__t", "SELECT c_custkey, o_totalprice AS c_acctbal, o_orderkey AS o_orderkey__t FROM customer JOIN orders ON c_custkey = o_custkey")
_update("upd_null_key", "UPDATE nation SET n_name = 'x' FROM (SELECT nullif(r_regionkey, 0) AS k FROM region) s WHERE n_regionkey = s.k", "n_nationkey; n_name", "SELECT n_nationkey, 'x' AS n_name FROM nation WHERE n_regionkey <> 0")
_update("upd_null_safe", "UPDATE nation SET n_name = 'x' FROM (SELECT nullif(r_regionkey, 0) AS k FROM region) s WHERE nullif(n_regionkey, 0) <=> s.k", "n_nationkey; n_name", "SELECT n_nationkey, 'x' AS n_name FROM nation")
_query("upd_merged", f"SELECT {_CUSTOMER}, round(coalesce(round(total / 7, 2), c_acctbal), 2) AS c_acctbal, coalesce(upper(substring(seg, 3)), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN {TOTALS} ON c_custkey = k")(
    lambda e, _: e.merged(FLAGSHIP).withColumn("c_acctbal", F.round("c_acctbal", 2))
)
_query("upd_merged_duplicate", "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey")(
    lambda e, _: e.merged("UPDATE nation SET n_name = r.r_name FROM region r WHERE nation.n_regionkey < r.r_regionkey", "duplicate")
)


_LATERAL = "UPDATE nation SET n_name = concat(r.r_name, x.i) FROM region r LATERAL VIEW explode(array(r.r_regionkey * 5, r.r_regionkey * 5 + 1)) x AS i WHERE nation.n_nationkey = x.i"
_update("upd_lateral", _LATERAL, "n_nationkey; n_name; n_regionkey", "SELECT n_nationkey, r_name || n_nationkey AS n_name, n_regionkey FROM nation JOIN region ON n_nationkey IN (r_regionkey * 5, r_regionkey * 5 + 1)")
_query("upd_merged_lateral", "SELECT n_nationkey, coalesce(r_name || n_nationkey, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_nationkey IN (r_regionkey * 5, r_regionkey * 5 + 1)")(lambda e, _: e.merged(_LATERAL))
_query("upd_first", "SELECT c_custkey, coalesce(max_by(o_totalprice, (o_totalprice, o_orderkey)), any_value(c_acctbal)) AS c_acctbal FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")(
    lambda e, _: e.merged("UPDATE customer SET c_acctbal = o.o_totalprice FROM orders o WHERE c_custkey = o.o_custkey", "first", "o.o_totalprice DESC, o.o_orderkey DESC").select("c_custkey", "c_acctbal")
)


@_query("upd_partition", "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN r_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def _partition(e: Engine, _: str) -> DataFrame:
    t = _fresh("partition")
    e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
    return e.sql(f"UPDATE {t} PARTITION (n_regionkey = 1) PARTITION (n_regionkey = '3') SET n_name = concat(r.r_name, '!') FROM region r WHERE {t}.n_regionkey = r.r_regionkey", persist=True).select("n_nationkey", "n_name", "n_regionkey")


@_query("upd_keyed_store", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def _keyed_store(e: Engine, _: str) -> DataFrame:
    t = _fresh("keyed")
    e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
    e.spark.sql(f"ALTER TABLE {t} SET TBLPROPERTIES ('{store.STORAGE_TYPE}' = 'es')")
    return e.sql(f"UPDATE {t} SET n_name = r.r_name FROM region r WHERE {t}.n_regionkey = r.r_regionkey AND r.r_regionkey = 2", persist=True).select("n_nationkey", "n_name", "n_regionkey")


@_query("upd_persist", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'ASIA!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _persist(e: Engine, _: str) -> DataFrame:
    t = _fresh("persist")
    e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
    return e.sql(f"UPDATE {t} SET n_name = concat(r.r_name, '!') FROM region r WHERE {t}.n_regionkey = r.r_regionkey AND r.r_regionkey = 2", persist=True).select("n_nationkey", "n_name", "n_regionkey")


_query("del_using", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")(lambda e, _: e.remaining("DELETE FROM customer USING orders o WHERE customer.c_custkey = o.o_custkey AND o.o_totalprice > 100000"))
_query("del_where", "SELECT * FROM customer WHERE c_acctbal <= 0 OR c_acctbal IS NULL")(lambda e, _: e.remaining("DELETE FROM customer WHERE c_acctbal > 0"))


# -- MAKE SNAPSHOT, RESTORE


def _snapshot(name: str, partitions: str, oracle: str, storage: str = "hive") -> None:
    @_query(name, oracle)
    def make(e: Engine, _: str) -> DataFrame:
        t, s = _fresh("nation"), _fresh("snapshot")
        e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
        e.spark.sql(f"ALTER TABLE {t} SET TBLPROPERTIES ('{store.STORAGE_TYPE}' = '{storage}')")
        e.sql(f"MAKE SNAPSHOT {s} FROM {t} {partitions}")
        return e.spark.table(s).select("n_nationkey", "n_name", "n_regionkey")


_snapshot("snap_full", "", "SELECT * FROM nation")
_snapshot("snap_partition", "PARTITION (n_regionkey = 1)", "SELECT * FROM nation WHERE n_regionkey = 1")
_snapshot("snap_partitions_multi", "PARTITION (n_regionkey = 1) PARTITION (n_regionkey = '3')", "SELECT * FROM nation WHERE n_regionkey IN (1, 3)")
_snapshot("snap_keyed_store", "", "SELECT * FROM nation", "hbase")


@_query("snap_buckets_comment", "SELECT 25::BIGINT AS n, 'kept' AS comment, '2' AS buckets")
def _snapshot_of_buckets(e: Engine, _: str) -> DataFrame:
    """A snapshot, and the table after a DELETE, have the buckets and the comment of the table."""
    t, s = _fresh("bucketed"), _fresh("snapshot")
    e.sql(f"CREATE TABLE {t} USING parquet CLUSTERED BY (n_nationkey) INTO 2 BUCKETS COMMENT 'kept' AS SELECT * FROM nation")
    e.sql(f"MAKE SNAPSHOT {s} FROM {t}")
    e.sql(f"DELETE FROM {t} WHERE n_nationkey < 0")
    both = [store.described(e.spark, x) for x in (t, s)]
    found = {(d.get("Comment"), d.get("Num Buckets")) for d in both}
    return e.spark.createDataFrame([(e.spark.table(s).count(), *f) for f in found], "n long, comment string, buckets string")


@_query("restore", "SELECT * FROM region")
def _restore(e: Engine, _: str) -> DataFrame:
    t, s = _fresh("region"), _fresh("snapshot")
    e.spark.table("region").write.saveAsTable(t)
    e.sql(f"MAKE SNAPSHOT {s} FROM {t}")
    e.sql(f"DELETE FROM {t} WHERE r_regionkey > 1")
    return e.sql(f"RESTORE {t} FROM {s}")


# -- models

#: Two features that part the labels by a wide gap, so that every sound fit puts all rows right.
_TRAINING = "(SELECT l_quantity + IF(l_quantity > 25, 50, 0) AS q, l_discount * 10 AS d, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label FROM lineitem) t"
_ALL_HIT = "SELECT count(*) AS n, count(*) AS hits FROM lineitem"
_FIXED = {"algorithm": "LogisticRegression", "features": [["q", "double"], ["d", "double"]], "coefficients": [[0.5, -1.0], [-0.5, 1.0]], "intercepts": [0.1, -0.1]}
_FIXED_CLASS = "CASE WHEN 0.1 + 0.5 * (l_quantity / 50) - l_discount * 10 >= -0.1 - 0.5 * (l_quantity / 50) + l_discount * 10 THEN 0 ELSE 1 END"


def _trained(name: str, algorithm: str) -> None:
    @_query(name, _ALL_HIT)
    def run(e: Engine, _: str) -> DataFrame:
        path, name = model_path(e.spark), _fresh("fn")
        e.sql(f"TRAIN MODEL {algorithm} FROM {_TRAINING} INTO '{path}'")
        e.sql(f"REGISTER MODEL {algorithm} FROM '{path}' AS {name}")
        return e.sql(f"SELECT count(1) AS n, sum(CASE WHEN label = {name}((q, d)) THEN 1 ELSE 0 END) AS hits FROM {_TRAINING}")


for _name, _algorithm in (("train_predict_accuracy", "LogisticRegression"), ("train_svm", "LinearSVC"), ("train_boosted", "GBTClassifier")):
    _trained(_name, _algorithm)


def model_path(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quern-model-{uuid.uuid4().hex}"


def _saved(e: Engine) -> str:
    """A model with known coefficients, saved as TRAIN saves one."""
    path = model_path(e.spark)
    e.spark.createDataFrame([(json.dumps(_FIXED),)], "value string").write.text(f"{path}/meta")
    return path


@_query("predict_registered", f"SELECT l_orderkey, l_linenumber, {_FIXED_CLASS} AS predicted FROM lineitem")
def _predict(e: Engine, _: str) -> DataFrame:
    name = _fresh("fixed")
    e.sql(f"REGISTER MODEL LogisticRegression FROM '{_saved(e)}' AS {name}")
    return e.sql(f"SELECT l_orderkey, l_linenumber, {name}(struct(l_quantity / 50, l_discount * 10)) AS predicted FROM lineitem")


@_query("predict_statement", f"SELECT l_orderkey, l_linenumber, {_FIXED_CLASS} AS klass FROM lineitem")
def _predict_statement(e: Engine, _: str) -> DataFrame:
    return e.sql(f"PREDICT MODEL LogisticRegression FROM '{_saved(e)}' ON (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_discount * 10 AS d FROM lineitem) x AS klass").select("l_orderkey", "l_linenumber", "klass")


#: A chain of a linear regression and a softmax, in the form that scikit-learn exports.
PMML = """<PMML xmlns="http://www.dmg.org/PMML-4_3"><MiningModel><Segmentation multipleModelMethod="modelChain">
<Segment id="1"><RegressionModel functionName="regression"><RegressionTable intercept="-1.5"><NumericPredictor name="l_quantity" coefficient="0.125"/><NumericPredictor name="l_discount" coefficient="-20.0"/></RegressionTable></RegressionModel></Segment>
<Segment id="2"><RegressionModel functionName="classification" normalizationMethod="softmax"><RegressionTable intercept="0.0" targetCategory="0"><NumericPredictor name="decisionFunction" coefficient="-1.0"/></RegressionTable>
<RegressionTable intercept="0.0" targetCategory="1"><NumericPredictor name="decisionFunction" coefficient="1.0"/></RegressionTable></RegressionModel></Segment></Segmentation></MiningModel></PMML>"""


@_query("pmml_score", "SELECT l_orderkey, l_linenumber, CASE WHEN -1.5::DOUBLE + 0.125::DOUBLE * l_quantity + -20.0::DOUBLE * l_discount > 0 THEN 1 ELSE 0 END AS klass FROM lineitem")
def _pmml(e: Engine, _: str) -> DataFrame:
    klass, _ = models.pmml_class(PMML)
    return e.spark.table("lineitem").select("l_orderkey", "l_linenumber", klass.alias("klass"))


@_query("deploy_model", "SELECT 'm' AS name, 'gw' AS gateway")
def _deploy(e: Engine, _: str) -> DataFrame:
    name = _fresh("m")
    return e.sql(f"DEPLOY MODEL {name} FROM '/models/m' TO gw OPTIONS (replicas = '2')").filter(F.col("name") == name).select(F.lit("m").alias("name"), "gateway")


_sql("udf_balance", "SELECT o_orderkey, getOldBalanceOrigValue(CAST(o_custkey % 2 AS DOUBLE), 0D, o_totalprice) AS old, getNewBalanceDestValue(0D, 5D, 1D) AS new FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_totalprice <> 0 THEN -1.0 ELSE o_custkey % 2 END::DOUBLE AS old, 5.0::DOUBLE AS new FROM orders")
_sql("udf_typecode", "SELECT o_orderkey, getTypeCode(CASE WHEN o_orderstatus = 'F' THEN 'TRANSFER' ELSE 'CASH_OUT' END) AS code FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS code FROM orders")
_sql("vec_max", "SELECT vec_id, round(vec_max(embedding), 5) AS m, vec_argmax(vec_dense(embedding)) AS a FROM embeddings", "SELECT vec_id, round(list_max(embedding)::DOUBLE, 5) AS m, list_position(embedding, list_max(embedding)) - 1 AS a FROM embeddings")

# -- row keys

_CONDITION = "(o_orderstatus = 'F' OR o_custkey = 7) AND (o_totalprice > 1000 AND o_orderkey BETWEEN 10 AND 900)"
_query("dnf_filter", f"SELECT o_orderkey FROM orders WHERE {_CONDITION}")(lambda e, _: e.spark.table("orders").filter(rowkey.dnf_column(_CONDITION)).select("o_orderkey"))
_KEY = "concat(reverse(event_type), '_', user_id, '_', event_id)"
_sql("rowkey_build", f"SELECT event_id, {_KEY} AS rk FROM events", "SELECT event_id, reverse(event_type) || '_' || user_id || '_' || event_id AS rk FROM events")


def _keyed_events(e: Engine) -> DataFrame:
    return e.spark.table("events").withColumn("rk", F.expr(_KEY))


_query("rowkey_prefix_scan", "SELECT event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id = 7 AND value > 1")(
    lambda e, _: rowkey.scan(_keyed_events(e), "rk", _KEY, f"event_type = '{e.spark.table('events').agg(F.min('event_type')).first()[0]}' AND user_id = 7 AND value > 1").select("event_id", "value")
)


def _keyed_path(e: Engine) -> str:
    return model_path(e.spark).replace("quern-model", "quern-keyed")


@_query("keyed_upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -2.0 ELSE value END AS value FROM events")
def _upsert(e: Engine, _: str) -> DataFrame:
    """Two new rows for every third key, of which the later one stays."""
    path, old = _keyed_path(e), e.spark.table("events").select("event_id", "value")
    keyed.write_keyed(old, path, "event_id")
    new = e.sql("SELECT event_id, CAST(-n AS DOUBLE) AS value, n FROM events LATERAL VIEW explode(array(2, 1)) x AS n WHERE event_id % 3 = 0")
    keyed.upsert(e.spark, path, new, "event_id", "n")
    return keyed.read(e.spark, path)


@_query("keyed_upsert_ranges", "SELECT event_id, CASE WHEN event_id < 50 THEN -1.0 ELSE value END AS value FROM events UNION ALL SELECT max(event_id) + 1, 0.0 FROM events")
def _upsert_ranges(e: Engine, _: str) -> DataFrame:
    """Few keys and a new one: other files stay."""
    path, old = _keyed_path(e), e.spark.table("events").select("event_id", "value")
    keyed.write_keyed(old, path, "event_id")
    keyed.upsert(e.spark, path, e.sql("SELECT event_id, -1D AS value, 1 AS n FROM events WHERE event_id < 50"), "event_id", "n")
    keyed.upsert(e.spark, path, e.sql("SELECT max(event_id) + 1 AS event_id, 0D AS value, 1 AS n FROM events"), "event_id", "n")
    keyed.vacuum(e.spark, path)
    return keyed.read(e.spark, path)


def _keyed_scan(name: str, condition: str) -> None:
    @_query(name, f"SELECT event_id FROM events WHERE {condition}")
    def run(e: Engine, _: str) -> DataFrame:
        path = _keyed_path(e)
        keyed.write_keyed(e.spark.table("events").select("event_id", "value", "props"), path, "event_id")
        return keyed.scan(e.spark, path, "event_id", ["event_id"], condition)


_keyed_scan("keyed_source_scan", "event_id BETWEEN 100 AND 200")
_keyed_scan("keyed_source_in", "event_id IN (3, 77, 500) AND value > 0")
_keyed_scan("keyed_source_open", "event_id > 10 AND event_id < 40")


@_query("rowkey_table_scan", "SELECT event_id, value FROM events WHERE event_type = (SELECT max(event_type) FROM events) AND user_id = 9")
def _rowkey_table(e: Engine, _: str) -> DataFrame:
    """A scan by the key that a table's properties describe."""
    t = _fresh("keyedtable")
    e.sql(f"CREATE TABLE {t} (rk STRING, event_id BIGINT, event_type STRING, user_id BIGINT, value DOUBLE) STORED BY 'a.b.Handler' WITH SERDEPROPERTIES ('{store.COLUMNS_MAPPING}' = ':key,f:id,f:type,f:user,f:value') TBLPROPERTIES ('{store.STORAGE_TYPE}' = 'hbase', '{store.ROWKEY_FUNCTION}' = \"{_KEY}\")")
    e.sql(f"INSERT INTO {t} SELECT {_KEY}, event_id, event_type, user_id, value FROM events")
    column, function = keyed.keyed_table(e.spark, t)
    last = e.spark.table("events").agg(F.max("event_type")).first()[0]
    return rowkey.scan(e.spark.table(t), column, function, f"event_type = '{last}' AND user_id = 9").select("event_id", "value")


@_query("jdbc_round_trip", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _jdbc(e: Engine, _: str) -> DataFrame:
    """Through the database that comes with Spark, in memory: it lives in the driver, which opens it alone on a cluster."""
    e.spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url, driver = f"jdbc:derby:memory:{_fresh('db')};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    jdbc.write(e.spark.table("nation"), url, "nation", driver=driver)
    return jdbc.read(e.spark, url, "nation", "n_nationkey", driver=driver).filter("n_regionkey = 2").select("n_nationkey", "n_name")


_query("arrow_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda e, _: e.spark.createDataFrame(arrow.from_ipc(arrow.to_ipc(e.spark.table("nation"), 1_000))))
_query("arrow_checksums", "SELECT sum(l_linenumber)::BIGINT AS sum_l_linenumber, sum(l_orderkey)::BIGINT AS sum_l_orderkey, 0::BIGINT AS nulls_l_linenumber, 0::BIGINT AS nulls_l_orderkey FROM lineitem")(lambda e, _: arrow.checksums(e.spark.table("lineitem"), ["l_linenumber", "l_orderkey"]))
_query("stream_windowed", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda e, _: streams.windowed(e.spark.table("events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))
)



def _stream(e: Engine, columns: str) -> tuple[DataFrame, str]:
    """The events as a stream of several files, and a folder for its checkpoint."""
    path = model_path(e.spark).replace("quern-model", "quern-stream")
    given = e.spark.sql(f"SELECT {columns} FROM events")
    given.repartition(3, "event_id").write.parquet(f"{path}/in")
    return e.spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


@_query("stream_complete", ORACLES["stream_windowed"])
def _stream_complete(e: Engine, _: str) -> DataFrame:
    """The windows of a stream that has ended: each batch writes the whole result so far."""
    source, path = _stream(e, "event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value")
    out = streams.windowed(source, "ts", "event_type", "value")
    out.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return e.spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("stream_upserts", "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def _stream_upserts(e: Engine, _: str) -> DataFrame:
    """The last event of each user, kept in a keyed table that every batch of a stream is merged into."""
    source, path = _stream(e, "user_id, event_id, value")
    merge = streams.upsert_batches(f"{path}/table", "user_id", "event_id")
    last = lambda batch, n: merge(_not_older(e, batch, f"{path}/table"), n)
    source.writeStream.foreachBatch(last).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return keyed.read(e.spark, f"{path}/table")


def _not_older(e: Engine, batch: DataFrame, path: str) -> DataFrame:
    """Files come in any order: rows that the table has later ones of are left out."""
    if not keyed._versions(e.spark, path):
        return batch
    known = keyed.read(e.spark, path).select("user_id", F.col("event_id").alias("__known"))
    return batch.join(known, "user_id", "left").filter("__known IS NULL OR event_id > __known").drop("__known")


# -- the delegated surface

_sql("values_inline", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y)")
_sql("tvf_range", "SELECT id FROM range(0, 10, 2)", "SELECT range AS id FROM range(0, 10, 2)")
_sql("lateral_view", "SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, '_')) x AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation")
_query("sample_rows")(lambda e, _: e.sql("SELECT * FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)"))
_query("sample_limit", "SELECT least(7, count(*)) AS n FROM orders")(lambda e, _: e.sql("SELECT count(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (7 ROWS))"))
_query("sample_all", "SELECT o_orderkey FROM orders")(lambda e, _: e.sql("SELECT o_orderkey FROM orders TABLESAMPLE (100 PERCENT)"))
_query("sample_bucket")(lambda e, _: e.sql("SELECT o_orderkey FROM orders TABLESAMPLE (BUCKET 1 OUT OF 4)"))
_query("script_transform", "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")(lambda e, _: e.sql("SELECT TRANSFORM (n_nationkey, n_name) USING 'cat' AS (k STRING, v STRING) FROM nation"))


@_query("csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _csv(e: Engine, _: str) -> DataFrame:
    path, view = model_path(e.spark).replace("quern-model", "quern-csv"), _fresh("csv")
    e.spark.table("nation").write.option("sep", ";").option("header", "true").csv(path)
    e.sql(f"CREATE TEMPORARY VIEW {view} (n_nationkey INT, n_name STRING, n_regionkey INT) USING csv OPTIONS (sep ';', header 'true', path '{path}')")
    return e.sql(f"SELECT * FROM {view}")


@_query("csv_reader", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _csv_reader(e: Engine, _: str) -> DataFrame:
    path = model_path(e.spark).replace("quern-model", "quern-csv")
    e.spark.table("nation").write.option("sep", "|").option("header", "true").csv(path)
    return e.spark.read.option("sep", "|").option("header", "true").option("inferSchema", "true").csv(path)


def _texts(e: Engine) -> str:
    """Nations as text files with tabs between the fields."""
    path = model_path(e.spark).replace("quern-model", "quern-text")
    e.spark.sql("SELECT concat_ws('\t', n_nationkey, n_name, n_regionkey) AS value FROM nation").write.text(path)
    return path


@_query("hive_text_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _hive_text(e: Engine, _: str) -> DataFrame:
    t = _fresh("hivetext")
    e.sql(f"CREATE EXTERNAL TABLE {t} (n_nationkey INT, n_name STRING, n_regionkey INT) COMMENT 'text' ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t' STORED AS TEXTFILE LOCATION '{_texts(e)}'")
    return e.sql(f"SELECT * FROM {t}")


@_query("load_data", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT -1, 'old', 0")
def _load_data(e: Engine, _: str) -> DataFrame:
    t = _fresh("loaded")
    e.sql(f"CREATE TABLE {t} (n_nationkey INT, n_name STRING, n_regionkey INT) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t'")
    e.sql(f"INSERT INTO {t} VALUES (-1, 'old', 0)")
    e.sql(f"LOAD DATA INPATH '{_texts(e)}' INTO TABLE {t}")
    return e.sql(f"SELECT * FROM {t}")


@_query("load_data_partition", "SELECT n_nationkey, n_name, 7 AS p FROM nation")
def _load_partition(e: Engine, _: str) -> DataFrame:
    t, path = _fresh("loaded"), model_path(e.spark).replace("quern-model", "quern-load")
    e.spark.table("nation").select("n_nationkey", "n_name").write.parquet(path)
    e.sql(f"CREATE TABLE {t} (n_nationkey INT, n_name STRING) PARTITIONED BY (p INT) STORED AS PARQUET")
    e.sql(f"INSERT INTO {t} VALUES (-1, 'old', 7)")
    e.sql(f"LOAD DATA INPATH '{path}' OVERWRITE INTO TABLE {t} PARTITION (p = 7)")
    return e.sql(f"SELECT * FROM {t}")


@_query("snap_directory", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 4")
def _snapshot_directory(e: Engine, _: str) -> DataFrame:
    t, s, path = _fresh("nation"), _fresh("snapshot"), model_path(e.spark).replace("quern-model", "quern-snapshot")
    e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
    e.sql(f"MAKE SNAPSHOT {s} DIRECTORY '{path}' FROM {t} PARTITION (n_regionkey = 4)")
    return e.spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@_query("insert_overwrite_partition", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _insert(e: Engine, _: str) -> DataFrame:
    t = _fresh("insert")
    e.spark.table("nation").write.partitionBy("n_regionkey").saveAsTable(t)
    e.sql(f"INSERT OVERWRITE TABLE {t} PARTITION (n_regionkey = 1) SELECT n_nationkey, 'new' FROM nation WHERE n_regionkey = 1")
    return e.sql(f"SELECT n_nationkey, n_name, n_regionkey FROM {t}")


@_query("stored_by_table", "SELECT n_nationkey, n_name FROM nation")
def _stored(e: Engine, _: str) -> DataFrame:
    t = _fresh("stored")
    e.sql(f"CREATE EXTERNAL TABLE {t} (n_nationkey INT, n_name STRING) STORED BY 'a.b.Handler' WITH SERDEPROPERTIES ('{store.COLUMNS_MAPPING}' = ':key,f:name') TBLPROPERTIES ('{store.STORAGE_TYPE}' = 'hbase')")
    e.sql(f"INSERT INTO {t} SELECT n_nationkey, n_name FROM nation")
    return e.sql(f"SELECT * FROM {t}")


_sql("filt_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_sql("filt_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
_sql("filt_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%S%' AND p_name NOT LIKE 'a%'")
_sql("filt_rlike", "SELECT p_partkey FROM part WHERE p_brand RLIKE '[13]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$')")
_sql("filt_nullsafe", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) <=> NULL OR c_mktsegment IS NULL", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL OR c_mktsegment IS NULL")
_sql("filt_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS b FROM orders")
_sql("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
for _how, _text in {
    "inner": "JOIN orders ON c_custkey = o_custkey", "left": "LEFT JOIN orders ON c_custkey = o_custkey", "right": "RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0",
    "full": "FULL OUTER JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0",
}.items():
    _sql(f"join_{_how}", f"SELECT c_custkey, o_orderkey FROM customer {_text}")
_sql("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_regionkey * 1000")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
_sql("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_sql("join_natural", "SELECT x, a, b FROM (SELECT n_nationkey AS x, n_name AS a FROM nation) NATURAL JOIN (SELECT n_nationkey AS x, n_regionkey AS b FROM nation)", "SELECT x, a, b FROM (SELECT n_nationkey AS x, n_name AS a FROM nation) s NATURAL JOIN (SELECT n_nationkey AS x, n_regionkey AS b FROM nation) t")
_sql("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) s JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) t USING (k)")
_sql("join_hint", "SELECT /*+ BROADCAST(nation) */ s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_sql("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
for _name, _spark, _duck in (("rollup", "n_regionkey, n_name WITH ROLLUP", "ROLLUP (n_regionkey, n_name)"), ("cube", "n_regionkey, n_name WITH CUBE", "CUBE (n_regionkey, n_name)"), ("grouping_sets", "n_regionkey, n_name GROUPING SETS ((n_regionkey), (n_name))", "GROUPING SETS ((n_regionkey), (n_name))")):
    _sql(f"agg_{_name}", f"SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY {_spark}", f"SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY {_duck}")
_sql("agg_min_max_by", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS a, max_by(n_name, n_nationkey) AS b FROM nation GROUP BY n_regionkey")
# one value besides nulls in each group, so that FIRST and LAST have one answer whatever the order of rows
_sql("agg_first_last", "SELECT n_regionkey, first(r_name) AS a, last(r_name) AS b, first(IF(n_nationkey % 2 = 0, r_name, NULL)) IGNORE NULLS AS c, last_value(IF(n_nationkey % 2 = 1, r_name, NULL), true) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
     "SELECT n_regionkey, min(r_name) AS a, min(r_name) AS b, min(CASE WHEN n_nationkey % 2 = 0 THEN r_name END) AS c, min(CASE WHEN n_nationkey % 2 = 1 THEN r_name END) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
_sql("win_rank", "SELECT o_orderkey, row_number() OVER w AS a, rank() OVER w AS b, dense_rank() OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
_sql("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders")
_sql("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
_sql("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n FROM orders")
_sql("win_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 6) AS c, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 6) AS p FROM orders")
_sql("sort_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("sort_cluster", "SELECT c_custkey FROM customer CLUSTER BY c_custkey", "SELECT c_custkey FROM customer")
_sql("sort_distribute", "SELECT c_custkey FROM customer DISTRIBUTE BY c_nationkey SORT BY c_custkey", "SELECT c_custkey FROM customer")
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT n_nationkey * 2 AS k FROM nation"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL")):
    _sql(f"set_{_name}", f"{_A} {_op} {_B}")
_sql("set_minus", f"{_A} MINUS {_B}", f"{_A} EXCEPT {_B}")
_sql("cte", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT o_custkey FROM a, b WHERE n = m")
_sql("select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql("fn_string", "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, lpad(p_brand, 12, '*') AS c, replace(p_type, 'S', 's') AS d, substring(p_name, -3) AS e, p_brand || '-' || p_type AS f, position('a' IN p_name) AS g, trim(BOTH 'B' FROM p_brand) AS h, reverse(p_name) AS i, translate(p_type, 'AE', '43') AS j FROM part")
_sql("fn_math", "SELECT o_orderkey, abs(-o_orderkey) AS a, ceil(o_totalprice) AS b, floor(o_totalprice) AS c, round(sqrt(o_totalprice), 6) AS d, round(ln(o_totalprice), 6) AS e, o_orderkey DIV 7 AS f, o_orderkey % 7 AS g, greatest(o_orderkey, o_custkey) AS h, round(pow(o_custkey, 2), 2) AS i, sign(o_totalprice) AS j FROM orders", "SELECT o_orderkey, abs(-o_orderkey) AS a, ceil(o_totalprice)::BIGINT AS b, floor(o_totalprice)::BIGINT AS c, round(sqrt(o_totalprice), 6) AS d, round(ln(o_totalprice), 6) AS e, o_orderkey // 7 AS f, o_orderkey % 7 AS g, greatest(o_orderkey, o_custkey) AS h, round(pow(o_custkey, 2), 2) AS i, sign(o_totalprice)::DOUBLE AS j FROM orders")
_sql("fn_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 5 AS c, ~o_orderkey AS d FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, ~o_orderkey AS d FROM orders")
_sql("fn_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff(date_add(CAST(o_orderdate AS DATE), 10), CAST(o_orderdate AS DATE)) AS d, last_day(CAST(o_orderdate AS DATE)) AS l, date_format(o_orderdate, 'yyyy-MM') AS f FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, 10 AS d, last_day(o_orderdate) AS l, strftime(o_orderdate, '%Y-%m') AS f FROM orders")
_sql("fn_array", "SELECT vec_id, size(embedding) AS a, array_contains(array(label, 2), 2) AS b, aggregate(transform(array(1, 2, label), x -> x + 1), 0, (s, x) -> s + x) AS c, sort_array(array(3, label, 1))[0] AS d, size(array_distinct(array(1, 1, label))) AS e FROM embeddings", "SELECT vec_id, len(embedding) AS a, true AS b, 6 + label AS c, least(1, label) AS d, CASE WHEN label = 1 THEN 1 ELSE 2 END AS e FROM embeddings")
_sql("fn_map", "SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey)['b'] AS a, size(map_keys(map('x', 1, 'y', 2))) AS b FROM nation", "SELECT n_nationkey, n_regionkey AS a, 2 AS b FROM nation")
_sql("fn_struct", "SELECT n_nationkey, struct(n_name, n_regionkey).n_name AS a, named_struct('k', n_regionkey).k AS b, named_struct('x', (n_name, n_regionkey)).x.n_regionkey AS c FROM nation", "SELECT n_nationkey, n_name AS a, n_regionkey AS b, n_regionkey AS c FROM nation")
_sql("fn_json", "SELECT n_nationkey, get_json_object(concat('{\"a\": ', n_regionkey, '}'), '$.a') AS a, from_json(concat('{\"b\": ', n_nationkey, '}'), 'b INT').b AS b FROM nation", "SELECT n_nationkey, n_regionkey::VARCHAR AS a, n_nationkey AS b FROM nation")
_sql("fn_hash", "SELECT n_nationkey, md5(n_name) AS a, sha2(n_name, 256) AS b FROM nation", "SELECT n_nationkey, md5(n_name) AS a, sha256(n_name) AS b FROM nation")
_sql("fn_conditional", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, nvl(nullif(c_mktsegment, 'BUILDING'), 'none') AS b, if(c_acctbal > 0, 1, 0) AS c, try_cast(c_name AS INT) AS d FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS b, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS c, try_cast(c_name AS INT) AS d FROM customer")


# -- formats, table creation and catalog statements

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _copy(e: Engine, name: str, using: str = "parquet", partition: str = "") -> str:
    t = _fresh(name)
    e.sql(f"CREATE TABLE {t} USING {using} {partition} AS {_NATION}")
    return t


def _format(using: str) -> None:
    _query(f"format_{using}", _NATION)(lambda e, _: e.sql(f"{_NATION.replace('FROM nation', '')} FROM {_copy(e, using, using)}"))


for _using in ("parquet", "orc", "json", "csv"):
    _format(_using)


_query("format_text", "SELECT n_name AS value FROM nation")(lambda e, _: e.sql(f"SELECT value FROM {_text_copy(e)}"))
_query("stored_as_orc", _NATION)(lambda e, _: e.sql(f"{_NATION.replace('FROM nation', '')} FROM {_stored_as(e)}"))


def _text_copy(e: Engine) -> str:
    t = _fresh("text")
    e.sql(f"CREATE TABLE {t} USING text AS SELECT n_name AS value FROM nation")
    return t


def _stored_as(e: Engine) -> str:
    t = _fresh("storedas")
    e.sql(f"CREATE TABLE {t} STORED AS ORC AS {_NATION}")
    return t


def _on_copy(name: str, oracle: str, *statements: str, partition: str = "PARTITIONED BY (n_regionkey)") -> None:
    """Statements over a copy ``{t}`` of nation (``{u}`` is a free name); the last of them gives the rows."""

    @_query(name, oracle)
    def run(e: Engine, _: str) -> DataFrame:
        names = {"t": _copy(e, name, partition=partition), "u": _fresh(name)}
        return [e.sql(s.format(**names)) for s in statements][-1]


_on_copy("ctas_bucketed", _NATION, f"{_NATION.replace('FROM nation', '')} FROM {{t}}", partition="PARTITIONED BY (n_regionkey) CLUSTERED BY (n_nationkey) INTO 2 BUCKETS")
_on_copy("table_like", "SELECT 0::BIGINT AS n", "CREATE TABLE {u} LIKE {t}", "SELECT count(n_regionkey) AS n FROM {u}")
_on_copy("insert_into", f"{_NATION} UNION ALL SELECT 99, 'new', 7", "INSERT INTO {t} PARTITION (n_regionkey = 7) SELECT 99, 'new'", "SELECT n_nationkey, n_name, n_regionkey FROM {t}")
_on_copy("insert_dynamic_partition", f"{_NATION} UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey + 10 FROM nation", "INSERT INTO {t} PARTITION (n_regionkey) SELECT n_nationkey + 100, n_name, n_regionkey + 10 FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM {t}")
_on_copy(
    "multi_insert", "SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN 'low' ELSE 'high' END AS s FROM nation", "CREATE TABLE {u} (k INT, s STRING) USING parquet",
    "FROM {t} INSERT INTO {u} SELECT n_nationkey, 'low' WHERE n_regionkey < 2 INSERT INTO {u} SELECT n_nationkey, 'high' WHERE n_regionkey >= 2", "SELECT k, s FROM {u}",
)
_on_copy("cat_show_partitions", "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS partition FROM nation", "SHOW PARTITIONS {t}")
_on_copy("cat_show_columns", "SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) AS t(col_name)", "SHOW COLUMNS IN {t}")
_on_copy("cat_drop_partition", "SELECT * FROM nation WHERE n_regionkey <> 1", "ALTER TABLE {t} DROP PARTITION (n_regionkey = 1)", "SELECT n_nationkey, n_name, n_regionkey FROM {t}")
_on_copy("cat_rename_partition", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS r FROM nation", "ALTER TABLE {t} PARTITION (n_regionkey = 1) RENAME TO PARTITION (n_regionkey = 11)", "SELECT n_nationkey, n_regionkey AS r FROM {t}")
_on_copy("cat_add_columns", "SELECT n_nationkey, NULL::INTEGER AS x FROM nation", "ALTER TABLE {t} ADD COLUMNS (x INT)", "SELECT n_nationkey, x FROM {t}")
_on_copy("cat_rename_table", "SELECT n_nationkey FROM nation", "ALTER TABLE {t} RENAME TO {u}", "SELECT n_nationkey FROM {u}", partition="")
_on_copy("cat_truncate", "SELECT 0::BIGINT AS n", "TRUNCATE TABLE {t}", "SELECT count(*) AS n FROM {t}")
_on_copy("cat_repair", "SELECT n_nationkey FROM nation", "MSCK REPAIR TABLE {t}", "ANALYZE TABLE {t} COMPUTE STATISTICS", "REFRESH TABLE {t}", "SELECT n_nationkey FROM {t}")
_on_copy("cat_cache", "SELECT n_nationkey FROM nation", "CACHE TABLE {t}", "UNCACHE TABLE {t}", "SELECT n_nationkey FROM {t}")
_on_copy("cat_view", "SELECT n_name AS b FROM nation WHERE n_regionkey = 2", "CREATE VIEW {u} AS SELECT n_nationkey AS a FROM {t}", "ALTER VIEW {u} AS SELECT n_name AS b FROM {t} WHERE n_regionkey = 2", "SELECT b FROM {u}")
_on_copy("cat_function", "SELECT n_nationkey, n_nationkey * 2 + 1 AS y FROM nation", "CREATE TEMPORARY FUNCTION {u} (x INT) RETURNS INT RETURN x * 2 + 1", "SELECT n_nationkey, {u}(n_nationkey) AS y FROM {t}")
_on_copy("cat_database", "SELECT n_nationkey FROM nation", "CREATE DATABASE {u}", "CREATE TABLE {u}.own USING parquet AS SELECT n_nationkey FROM {t}", "SELECT n_nationkey FROM {u}.own")
_on_copy("cat_properties", "SELECT 'k' AS key, 'v' AS value", "ALTER TABLE {t} SET TBLPROPERTIES ('k' = 'v', 'w' = 'x')", "ALTER TABLE {t} UNSET TBLPROPERTIES ('w')", "SHOW TBLPROPERTIES {t} ('k')")


_on_copy("cat_use", "SELECT count(*) AS n FROM nation", "CREATE DATABASE {u}", "USE {u}", "CREATE TABLE own USING parquet AS SELECT * FROM default.{t}", "USE default", "SELECT count(*) AS n FROM {u}.own")
_on_copy("cat_alter_database", "SELECT 'kept' AS v", "CREATE DATABASE {u}", "ALTER DATABASE {u} SET DBPROPERTIES ('k' = 'kept')", "DESCRIBE DATABASE EXTENDED {u}", "SELECT 'kept' AS v")
_on_copy("cat_drop_database", "SELECT 0::BIGINT AS n", "CREATE DATABASE {u}", "CREATE TABLE {u}.own USING parquet AS SELECT * FROM {t}", "DROP DATABASE {u} CASCADE", "CREATE DATABASE {u}", "CREATE TABLE {u}.own (x INT) USING parquet", "SELECT count(*) AS n FROM {u}.own")
_on_copy("cat_add_partition", "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS partition FROM nation UNION ALL SELECT 'n_regionkey=77'", "ALTER TABLE {t} ADD PARTITION (n_regionkey = 77)", "SHOW PARTITIONS {t}")
_on_copy("cat_recover_partitions", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "ALTER TABLE {t} RECOVER PARTITIONS", "SELECT n_nationkey, n_name, n_regionkey FROM {t}")
_on_copy("cat_drop_table", "SELECT 1 AS x", "DROP TABLE {t}", "CREATE TABLE {t} USING parquet AS SELECT 1 AS x", "SELECT x FROM {t}")
_on_copy("cat_drop_view", "SELECT 1 AS x", "CREATE VIEW {u} AS SELECT * FROM {t}", "DROP VIEW {u}", "CREATE VIEW {u} AS SELECT 1 AS x", "SELECT x FROM {u}")
_on_copy("cat_drop_function", "SELECT 3 AS y", "CREATE TEMPORARY FUNCTION {u} (x INT) RETURNS INT RETURN x", "DROP TEMPORARY FUNCTION {u}", "CREATE TEMPORARY FUNCTION {u} (x INT) RETURNS INT RETURN x + 1", "SELECT {u}(2) AS y")
_on_copy("cat_function_listed", "SELECT 'substring' AS function", "SHOW FUNCTIONS LIKE 'substring'")
_on_copy("cat_set", "SELECT 'quern.note' AS key, 'on' AS value", "SET quern.note=on", "SET quern.note")
_on_copy("cat_reset", "SELECT 'quern.note' AS key, '<undefined>' AS value", "SET quern.note=on", "RESET quern.note", "SET quern.note")


def _shown(name: str, oracle: str, statement: str, columns: tuple[str, ...], *before: str, where: str = "true", partition: str = "") -> None:
    """What a statement shows of a fresh copy, by the columns named and the rows of interest; names of tables are read as ``t`` and ``u``."""

    @_query(name, oracle)
    def run(e: Engine, _: str) -> DataFrame:
        names = {"t": _copy(e, name, partition=partition), "u": _fresh(name)}
        for s in before:
            e.sql(s.format(**names))
        out = e.sql(statement.format(**names)).filter(where).selectExpr(*columns)
        for k, v in names.items():
            out = out.select(*(F.replace(F.col(c), F.lit(v), F.lit(k)).alias(c) if f.dataType.simpleString() == "string" else F.col(c) for c, f in zip(out.columns, out.schema, strict=True)))
        return out


_shown("cat_show_tables", "SELECT 't' AS tableName, false AS isTemporary", "SHOW TABLES LIKE '{t}'", ("tableName", "isTemporary"))
_shown("cat_show_databases", "SELECT 'u' AS namespace", "SHOW DATABASES LIKE '{u}'", ("namespace",), "CREATE DATABASE {u}")
_shown("cat_show_create", "SELECT true AS made, true AS parquet", "SHOW CREATE TABLE {t}", ("createtab_stmt LIKE 'CREATE TABLE%' AS made", "contains(createtab_stmt, 'USING parquet') AS parquet"))
_shown("cat_explain", "SELECT true AS planned", "EXPLAIN SELECT * FROM {t} WHERE n_regionkey = 1", ("contains(plan, 'PushedFilters') AS planned",))
_shown("cat_describe_function", "SELECT 'Function: substring' AS d", "DESCRIBE FUNCTION substring", ("function_desc AS d",), where="function_desc LIKE 'Function:%'")
_shown("cat_describe_database", "SELECT 'Namespace Name' AS k, 'u' AS v", "DESCRIBE DATABASE {u}", ("info_name AS k", "info_value AS v"), "CREATE DATABASE {u}", where="info_name = 'Namespace Name'")
_shown("cat_describe_extended", "SELECT 'Provider' AS k, 'parquet' AS v", "DESCRIBE TABLE EXTENDED {t}", ("col_name AS k", "data_type AS v"), where="col_name = 'Provider'")
_shown("cat_describe_table", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(col_name, data_type)", "DESCRIBE TABLE {t}", ("col_name", "data_type"))
_shown("cat_change_column", "SELECT 'n_name' AS col_name, 'a note' AS comment", "DESCRIBE TABLE {t}", ("col_name", "comment"), "ALTER TABLE {t} CHANGE COLUMN n_name n_name STRING COMMENT 'a note'", where="comment IS NOT NULL")


@_query("cat_set_location", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _set_location(e: Engine, _: str) -> DataFrame:
    t, path = _fresh("located"), model_path(e.spark).replace("quern-model", "quern-location")
    e.sql(f"CREATE TABLE {t} USING parquet AS SELECT n_nationkey, n_name FROM nation")
    e.spark.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2").write.parquet(path)
    e.sql(f"ALTER TABLE {t} SET LOCATION '{path}'")
    return e.sql(f"SELECT n_nationkey, n_name FROM {t}")


#: Statements that are refused: those that the dialect's language declares unsupported, and some of Spark's that this catalog lacks.
_REFUSED = ("SET ROLE admin", "GRANT SELECT ON nation TO bob", "SHOW ROLES", "EXPORT TABLE nation TO '/x'", "LOCK TABLE nation SHARED", "CREATE INDEX i ON TABLE nation (n_name) AS 'x'", "START TRANSACTION", "COMMIT", "ROLLBACK", "DFS -ls /",
            "CREATE TABLE refused (a INT) USING parquet SKEWED BY (a) ON (1)", "ALTER TABLE nation SET SERDE 'x'", "CREATE TABLE refused (a INT) ROW FORMAT SERDE 'x'", "MAKE SNAPSHOT a FROM nation PARTITION (n_regionkey = 1)")


@_query("refused_statements", "SELECT * FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', true)" for s in _REFUSED) + ") AS t(statement, refused)")
def _refused(e: Engine, _: str) -> DataFrame:
    def refuses(text: str) -> bool:
        try:
            e.sql(text)
        except Exception:  # noqa: BLE001 - whichever layer refuses it
            return True
        return False

    return e.spark.createDataFrame([(s, refuses(s)) for s in _REFUSED], "statement string, refused boolean")


@_query("insert_directory", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _directory(e: Engine, _: str) -> DataFrame:
    path = model_path(e.spark).replace("quern-model", "quern-directory")
    e.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    return e.spark.read.parquet(path)


# -- further forms of relations, aggregates, windows and functions

_sql("table_shorthand", "TABLE nation", "SELECT * FROM nation")
_sql("from_first_select", "FROM nation SELECT n_name, n_regionkey WHERE n_regionkey > 2", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2")
_sql("alias_columns", "SELECT a, b FROM (SELECT n_nationkey, n_name FROM nation) AS t(a, b)")
_sql("lateral_view_outer", "SELECT n_nationkey, w FROM nation LATERAL VIEW OUTER explode(IF(n_regionkey = 1, array(n_name), CAST(array() AS ARRAY<STRING>))) x AS w", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name END AS w FROM nation")
_sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_sql("filt_distinct_from", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 5")
_sql("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS a, round(var_pop(l_quantity), 5) AS b, round(corr(l_quantity, l_extendedprice), 5) AS c, percentile(l_quantity, 0.5) AS d, count_if(l_discount > 0.05) AS e, bool_or(l_tax > 0.07) AS f FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS a, round(var_pop(l_quantity), 5) AS b, round(corr(l_quantity, l_extendedprice), 5) AS c, quantile_cont(l_quantity, 0.5) AS d, count(*) FILTER (l_discount > 0.05) AS e, bool_or(l_tax > 0.07) AS f FROM lineitem GROUP BY l_returnflag")
_sql("win_nth_value", "SELECT c_custkey, nth_value(c_custkey, 2) OVER w AS a, last_value(c_custkey) OVER w AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_sql("win_ignore_nulls", "SELECT c_custkey, last_value(nullif(c_nationkey, 3), true) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM customer",
     "SELECT c_custkey, last_value(nullif(c_nationkey, 3) IGNORE NULLS) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM customer")
_sql("fn_string_more", "SELECT p_partkey, reverse(p_name) AS a, regexp_replace(p_brand, '[0-9]+', '#') AS b, regexp_extract(p_brand, '([0-9]+)', 1) AS c, instr(p_name, 'e') AS d, translate(p_type, 'AE', 'ae') AS e, rpad(p_brand, 12, '.') AS f, split(p_name, ' ')[0] AS g, concat_ws('/', p_brand, p_type) AS h FROM part",
     "SELECT p_partkey, reverse(p_name) AS a, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS b, regexp_extract(p_brand, '([0-9]+)', 1) AS c, instr(p_name, 'e') AS d, translate(p_type, 'AE', 'ae') AS e, rpad(p_brand, 12, '.') AS f, string_split(p_name, ' ')[1] AS g, concat_ws('/', p_brand, p_type) AS h FROM part")
_sql("fn_math_more", "SELECT o_orderkey, round(exp(o_custkey / 10000), 6) AS a, round(pow(o_custkey, 2), 3) AS b, sign(o_totalprice - 100000) AS c, least(o_orderkey, o_custkey) AS d, pmod(-o_orderkey, 7) AS e, round(log(10, o_totalprice), 6) AS f FROM orders",
     "SELECT o_orderkey, round(exp(o_custkey / 10000), 6) AS a, round(pow(o_custkey, 2), 3) AS b, sign(o_totalprice - 100000)::DOUBLE AS c, least(o_orderkey, o_custkey) AS d, ((-o_orderkey % 7) + 7) % 7 AS e, round(log(10, o_totalprice), 6) AS f FROM orders")
_sql("fn_date_more", "SELECT o_orderkey, dayofweek(o_orderdate) AS a, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS b, CAST(date_sub(CAST(o_orderdate AS DATE), 3) AS STRING) AS c, quarter(o_orderdate) AS d, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS e FROM orders",
     "SELECT o_orderkey, dayofweek(o_orderdate) + 1 AS a, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS b, (o_orderdate::DATE - 3)::VARCHAR AS c, quarter(o_orderdate) AS d, date_trunc('month', o_orderdate)::DATE::VARCHAR AS e FROM orders")
_sql("fn_array_more", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS a, exists(embedding, x -> x > 1000) AS b, array_max(array(1, label)) AS c FROM embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS a, false AS b, greatest(1, label) AS c FROM embeddings")


_sql("limit_all", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT ALL", "SELECT n_nationkey FROM nation")
_sql("set_precedence", "SELECT k FROM (SELECT 1 AS k) UNION ALL SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region WHERE r_regionkey > 2", "SELECT 1 AS k UNION ALL (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 2)")
_sql("win_distribute_sort", "SELECT c_custkey, row_number() OVER (DISTRIBUTE BY c_nationkey SORT BY c_custkey) AS a, sum(c_custkey) OVER (PARTITION BY c_nationkey) AS b FROM customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, (sum(c_custkey) OVER (PARTITION BY c_nationkey))::BIGINT AS b FROM customer")
_sql("win_cluster", "SELECT n_nationkey, count(*) OVER (CLUSTER BY n_regionkey) AS n FROM nation", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
for _hint in ("MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL"):
    _sql(f"join_hint_{_hint.lower()}", f"SELECT /*+ {_hint}(supplier) */ s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_sql("fn_trim", "SELECT p_partkey, trim(LEADING 'B' FROM p_brand) AS a, trim(TRAILING '3' FROM p_brand) AS b, ltrim('B', p_brand) AS c, rtrim('3', p_brand) AS d, initcap(lower(p_type)) AS e, substr(p_name, 0, 4) AS f, substring(p_name, 2, 3) AS g FROM part",
     "SELECT p_partkey, ltrim(p_brand, 'B') AS a, rtrim(p_brand, '3') AS b, ltrim(p_brand, 'B') AS c, rtrim(p_brand, '3') AS d, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS e, substr(p_name, 1, 4) AS f, substr(p_name, 2, 3) AS g FROM part")
# texts name their zone, so that results don't depend on the session's
_sql("fn_unix_timestamp", "SELECT o_orderkey, unix_timestamp(concat(CAST(o_orderdate AS STRING), ' UTC'), 'yyyy-MM-dd HH:mm:ss VV') AS a, from_unixtime(unix_timestamp('1971-02-03 04:05:06', 'yyyy-MM-dd HH:mm:ss')) AS b, unix_timestamp('20190601 12 UTC', 'yyyyMMdd HH VV') AS c, to_unix_timestamp(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 00 UTC'), 'yyyy-MM-dd HH VV') AS d FROM orders",
     "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS a, '1971-02-03 04:05:06' AS b, epoch(TIMESTAMP '2019-06-01 12:00:00')::BIGINT AS c, epoch(date_trunc('day', o_orderdate))::BIGINT AS d FROM orders")
_sql("fn_time_zone", "SELECT o_orderkey, date_format(from_utc_timestamp(CAST(o_orderdate AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm') AS a, date_format(to_utc_timestamp(CAST(o_orderdate AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm') AS b, current_timezone() IS NOT NULL AS c FROM orders",
     "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS a, strftime(o_orderdate - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS b, true AS c FROM orders")
_sql("fn_literals", "SELECT n_nationkey, CAST(DATE '2020-02-29' + INTERVAL 1 DAY AS STRING) AS a, date_format(TIMESTAMP '2020-01-01 00:00:00' + INTERVAL '1 02:03' DAY TO MINUTE, 'yyyy-MM-dd HH:mm') AS b, CAST(DATE '2020-01-31' + INTERVAL 1 MONTH AS STRING) AS c, 1L + 2S + 3Y AS d, 1.5D AS e, 2.50BD = 2.5 AS f, 'a' 'b' AS g, X'41' = CAST('A' AS BINARY) AS h, TRUE AND NOT FALSE AS i, CAST(NULL AS INT) AS j, 1e3 AS k FROM nation",
     "SELECT n_nationkey, '2020-03-01' AS a, '2020-01-02 02:03' AS b, '2020-02-29' AS c, 6::BIGINT AS d, 1.5::DOUBLE AS e, true AS f, 'ab' AS g, true AS h, true AS i, NULL::INTEGER AS j, 1000.0::DOUBLE AS k FROM nation")
_sql("fn_map_more", "SELECT n_nationkey, map_values(map('a', n_nationkey, 'b', n_regionkey))[1] AS a, map_entries(map('k', n_name))[0].value AS b, size(map_from_arrays(array('x', 'y'), array(1, 2))) AS c, map_contains_key(map('x', 1), 'x') AS d, element_at(map_concat(map('p', 1), map('q', n_regionkey)), 'q') AS e FROM nation",
     "SELECT n_nationkey, n_regionkey AS a, n_name AS b, 2 AS c, true AS d, n_regionkey AS e FROM nation")
_sql("fn_json_more", "SELECT n_nationkey, to_json(named_struct('a', n_nationkey, 'b', n_name)) AS a, j.x AS b, j.y AS c FROM nation LATERAL VIEW json_tuple(concat('{\"x\": \"', n_name, '\", \"y\": ', n_regionkey, '}'), 'x', 'y') j AS x, y",
     "SELECT n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation")
# fixed values: published results of these hashes
_sql("fn_hash_more", "SELECT n_nationkey, crc32('Spark') AS a, hash('Spark', array(123), 2) AS b, xxhash64('Spark', array(123), 2) AS c, sha1(n_name) AS d, sha(n_name) = sha1(n_name) AS e FROM nation", "SELECT n_nationkey, 1557323817::BIGINT AS a, -1321691492 AS b, 5602566077635097486::BIGINT AS c, sha1(n_name) AS d, true AS e FROM nation")


# -- Python functions, in batches: what the engine accepts beside SQL


@F.pandas_udf(DoubleType())
def _halved(v: pd.Series) -> pd.Series:
    return v / 2


@F.pandas_udf(DoubleType())
def _spread(v: pd.Series) -> float:
    return float(v.max() - v.min())


_query("py_scalar", "SELECT c_custkey, c_acctbal / 2 AS h FROM customer")(lambda e, _: e.spark.table("customer").select("c_custkey", _halved("c_acctbal").alias("h")))
_query("py_grouped_aggregate", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS s FROM customer GROUP BY c_nationkey")(lambda e, _: e.spark.table("customer").groupBy("c_nationkey").agg(_spread("c_acctbal").alias("s")))
_query("py_grouped_map", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal)::DOUBLE AS k FROM customer")(
    lambda e, _: e.spark.table("customer").groupBy("c_nationkey").applyInPandas(lambda p: p[["c_custkey"]].assign(k=p.c_acctbal.rank(method="min")), "c_custkey long, k double")
)


@F.pandas_udf(DoubleType())
def _running(v: pd.Series) -> float:
    return float(v.sum())


def _in_batches(batches):
    for batch in batches:
        yield batch[["c_custkey"]].assign(h=batch.c_acctbal / 2)


@F.pandas_udf(DoubleType())
def _halved_in_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in batches:
        yield v / 2


@F.udf(DoubleType())
def _halved_row(v: float) -> float:
    return v / 2


_query("py_window_aggregate", "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS s FROM customer")(
    lambda e, _: e.spark.table("customer").select("c_custkey", F.round(_running("c_acctbal").over(Window.partitionBy("c_nationkey")), 4).alias("s"))
)
_query("py_batches", "SELECT c_custkey, c_acctbal / 2 AS h FROM customer")(lambda e, _: e.spark.table("customer").mapInPandas(_in_batches, "c_custkey long, h double"))
_query("py_scalar_batches", "SELECT c_custkey, c_acctbal / 2 AS h FROM customer")(lambda e, _: e.spark.table("customer").select("c_custkey", _halved_in_batches("c_acctbal").alias("h")))
_query("py_row", "SELECT c_custkey, c_acctbal / 2 AS h FROM customer")(lambda e, _: e.spark.table("customer").select("c_custkey", _halved_row("c_acctbal").alias("h")))
_query("py_cogrouped_map", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")(
    lambda e, _: e.spark.table("nation").groupBy("n_regionkey").cogroup(e.spark.table("region").groupBy("r_regionkey")).applyInPandas(lambda a, b: pd.DataFrame({"k": b.r_regionkey, "n": len(a)}), "k int, n long")
)


@_query("py_macros", "SELECT o_orderkey, o_totalprice * 2 + 1 AS a, upper(o_orderstatus) AS b FROM orders")
def _macros(e: Engine, _: str) -> DataFrame:
    """A table of macros (name, parameters, body), registered at once and inlined."""
    names = functions.macros(e.spark, {f"{_fresh('twice')}": ("x DOUBLE", "x * 2 + 1"), f"{_fresh('big')}": ("s STRING", "upper(s)")})
    return e.sql(f"SELECT o_orderkey, {names[0]}(o_totalprice) AS a, {names[1]}(o_orderstatus) AS b FROM orders")


@_query("py_registered", "SELECT c_custkey, c_acctbal / 2 AS h FROM customer")
def _registered_function(e: Engine, _: str) -> DataFrame:
    e.spark.udf.register("quern_halved", _halved)
    return e.sql("SELECT c_custkey, quern_halved(c_acctbal) AS h FROM customer")
