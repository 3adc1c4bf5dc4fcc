import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quern import queries
from quern.engine import Engine
from quern.functions import models
from quern.operators import store
from quern.plans import rowkey
from quern.plans import statements as S
from quern.plans.lexer import ParseError, split, tokens
from quern.sources import arrow, keyed
from quern.streaming import events as streams

KEY = "concat(lpad(shop, 5, '0'), '/', 99991231 - CAST(day AS INT), '/', upper(clerk), '/', slip)"
SCHEMA = T.StructType([T.StructField("shop", T.StringType()), T.StructField("day", T.StringType()), T.StructField("clerk", T.StringType()), T.StructField("slip", T.IntegerType())])


def test_statements():
    u = S.parse("UPDATE p01 SET age = tm.age + 2, job = concat(tm.job, ',x = FROM') FROM (SELECT a FROM b WHERE c) tm WHERE p01.name = tm.name -- end")
    assert u == S.UpdateFrom("p01", (("age", "tm.age + 2"), ("job", "concat(tm.job, ',x = FROM')")), "(SELECT a FROM b WHERE c) tm", "p01.name = tm.name")
    m = S.parse("make snapshot a local directory '/x' from b partition (age=21, sex='F') partition (age=25)")
    assert m == S.MakeSnapshot("a", "b", ((("age", "21"), ("sex", "F")), (("age", "25"),)), "/x", True)
    assert isinstance(S.parse("UPDATE t SET a = 1 WHERE b"), S.Passthrough)
    assert isinstance(S.parse("SELECT update, train FROM make"), S.Passthrough)
    assert S.parse("UPDATE t SET a = b IS DISTINCT FROM c FROM s WHERE t.k = s.k").sets == (("a", "b IS DISTINCT FROM c"),)
    assert "USING parquet" in S.parse("CREATE TABLE t (a INT) STORED BY 'x' TBLPROPERTIES ('k' = 'v')").text
    assert split("a, f(b, c), ','") == ["a", "f(b, c)", "','"]
    assert [t.text for t in tokens("a /* x */ <=> `b``c` /*+ h */")][:3] == ["a", "<=>", "`b``c`"]


@pytest.mark.parametrize("text", ["MAKE SNAPSHOT a FROM b PARTITION (x)", "MAKE SNAPSHOT a FROM b PARTITION (x=1, X=2)", "UPDATE t SET a = 1 FROM s", "UPDATE t SET a = 1 FROM (SELECT 1) WHERE x", "TRAIN MODEL LogisticRegression FROM t", "UPDATE t SET a = 'x FROM s WHERE y"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        S.parse(text)


def test_dnf_cases():
    assert rowkey.to_dnf("(a = 1 AND b = 2) AND c = 3") == [["a = 1", "b = 2", "c = 3"]]
    assert rowkey.to_dnf("a = 1 OR b = 2") == [["a = 1"], ["b = 2"]]
    assert rowkey.to_dnf("a BETWEEN 1 AND 2 AND (b OR c)") == [["a BETWEEN 1 AND 2", "b"], ["a BETWEEN 1 AND 2", "c"]]


expressions = st.recursive(st.sampled_from(["a > 0", "b > 0", "c > 0"]), lambda x: st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(expressions)
def test_dnf_is_equal(text):
    for bits in range(8):
        row = {c: bits >> k & 1 for k, c in enumerate("abc")}
        value = lambda e: eval(e.replace("AND", "and").replace("OR", "or"), {}, row)  # noqa: E731, S307
        assert bool(value(text)) == any(all(value(a) for a in b) for b in rowkey.to_dnf(text))


def test_prefixes(spark):
    found = rowkey.prefixes(KEY, SCHEMA)
    assert [sorted(p.attributes) for p in found] == [["clerk", "day", "shop", "slip"], ["clerk", "day", "shop"], ["day", "shop"], ["shop"]]
    prefix = rowkey.key_prefix(spark, KEY, SCHEMA, ["shop = '77'", "day = '20210304'", "slip > 3"])
    assert prefix == "00077/79780927"  # the shortest expression with its columns
    whole = spark.createDataFrame([("77", "20210304", "ann", 5)], SCHEMA).selectExpr(KEY).first()[0]
    assert whole.startswith(prefix)
    assert rowkey.key_prefix(spark, KEY, SCHEMA, ["slip = 5"]) is None


def pairs(e, spark):
    spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 1, "c")], "k int, p int, v string").createOrReplaceTempView("many")
    spark.createDataFrame([([1, 2], "x"), ([2], "y")], "ks array<int>, w string").createOrReplaceTempView("lists")


def test_lateral_views_as_sources(spark):
    e = Engine(spark)
    pairs(e, spark)
    text = "UPDATE many SET v = concat(l.w, x.i) FROM lists l LATERAL VIEW explode(l.ks) x AS i WHERE many.k = x.i AND l.w = 'x'"
    assert sorted((r.k, r.v) for r in e.sql(text).collect()) == [(1, "x1"), (2, "x2")]
    assert sorted((r.k, r.v) for r in e.merged(text).collect()) == [(1, "x1"), (2, "x2"), (3, "c")]
    twice = text.replace(" AND l.w = 'x'", "")
    with pytest.raises(Exception, match="several source rows"):
        e.merged(twice).collect()
    assert sorted((r.k, r.v) for r in e.merged(twice, "first", "l.w DESC").collect()) == [(1, "x1"), (2, "y2"), (3, "c")]
    assert sorted((r.k, r.v) for r in e.merged(twice, "duplicate").collect()) == [(1, "x1"), (2, "x2"), (2, "y2"), (3, "c")]
    outer = "UPDATE many SET v = 'z' FROM lists l LATERAL VIEW OUTER posexplode(l.ks) x AS i, j LATERAL VIEW explode(array(l.w)) y AS u WHERE many.k = x.j AND y.u = 'y'"
    assert sorted((r.k, r.v) for r in e.merged(outer).collect()) == [(1, "a"), (2, "z"), (3, "c")]


def test_update_of_named_partitions(spark):
    e = Engine(spark)
    pairs(e, spark)
    spark.sql("DROP TABLE IF EXISTS parted")
    spark.sql("CREATE TABLE parted (k INT, v STRING, p INT) USING parquet PARTITIONED BY (p) CLUSTERED BY (k) INTO 2 BUCKETS COMMENT 'it''s kept'")
    spark.sql("INSERT INTO parted SELECT k, v, p FROM many")
    text = "UPDATE parted PARTITION (p = 0) SET v = upper(s.v) FROM many s WHERE parted.k = s.k"
    assert sorted((r.k, r.v) for r in e.sql(text).collect()) == [(1, "A"), (2, "B")]
    files = lambda: sorted(f for f in spark.table("parted").inputFiles() if "p=1" in f)
    before = files()
    assert sorted((r.k, r.v) for r in e.sql(text, persist=True).collect()) == [(1, "A"), (2, "B"), (3, "c")]
    assert files() == before  # the other partition isn't touched
    with pytest.raises(store.AnalysisError):
        e.sql("UPDATE parted PARTITION (k = 0) SET v = 'x' FROM many s WHERE parted.k = s.k")
    # a move between partitions is a swap, which keeps buckets and comment
    e.sql("UPDATE parted PARTITION (p = 0) SET p = 7 FROM many s WHERE parted.k = s.k", persist=True)
    assert sorted((r.k, r.p) for r in spark.table("parted").collect()) == [(1, 7), (2, 7), (3, 1)]
    own = store.described(spark, "parted")
    assert (own["Comment"], own["Num Buckets"]) == ("it's kept", "2")


def test_keyed_stores_rewrite_only_partitions_hit(spark):
    e = Engine(spark)
    pairs(e, spark)
    spark.sql("DROP TABLE IF EXISTS keyedparts")
    spark.sql(f"CREATE TABLE keyedparts (k INT, v STRING, p INT) USING parquet PARTITIONED BY (p) TBLPROPERTIES ('{store.STORAGE_TYPE}' = 'es')")
    spark.sql("INSERT INTO keyedparts SELECT k, v, p FROM many")
    kept = [f for f in spark.table("keyedparts").inputFiles() if "p=0" in f]
    e.sql("UPDATE keyedparts SET v = 'new' FROM many s WHERE keyedparts.k = s.k AND s.k = 3", persist=True)
    assert sorted((r.k, r.v) for r in spark.table("keyedparts").collect()) == [(1, "a"), (2, "b"), (3, "new")]
    assert [f for f in spark.table("keyedparts").inputFiles() if "p=0" in f] == kept
    # rows of the partition without a value are found too: then the whole table is replaced
    spark.sql("INSERT INTO keyedparts VALUES (9, 'none', NULL)")
    e.sql("UPDATE keyedparts SET v = 'newer' FROM (SELECT 9 AS k) s WHERE keyedparts.k = s.k", persist=True)
    assert sorted((r.k, r.v) for r in spark.table("keyedparts").collect()) == [(1, "a"), (2, "b"), (3, "new"), (9, "newer")]


@pytest.mark.parametrize("external", [False, True])
def test_a_swap_that_breaks_off_is_recovered(spark, tmp_path, monkeypatch, external):
    e, t = Engine(spark), f"broken{int(external)}"
    spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.sql(f"CREATE TABLE {t} (id BIGINT, p INT) USING parquet PARTITIONED BY (p) " + (f"LOCATION '{tmp_path}/outside'" if external else ""))
    spark.sql(f"INSERT INTO {t} SELECT id, id % 2 FROM range(6)")
    rename, calls = store.rename, []

    def second_fails(spark, a, b):
        calls.append((a, b))
        if len(calls) == 2:
            raise RuntimeError("lost")
        rename(spark, a, b)

    monkeypatch.setattr(store, "rename", second_fails)
    with pytest.raises(RuntimeError):
        e.sql(f"DELETE FROM {t} WHERE id = 3")
    assert not spark.catalog.tableExists(t)
    monkeypatch.setattr(store, "rename", rename)
    assert e.recover(t) == "finished" and e.recover(t) == "whole"
    assert sorted(r.id for r in spark.table(t).collect()) == [0, 1, 2, 4, 5]
    assert spark.table(t).filter("p = 1").count() == 2
    assert spark.table(calls[0][1]).count() == 6
    own = store.described(spark, t)
    assert own["Type"] == ("EXTERNAL" if external else "MANAGED") and (str(tmp_path) in own["Location"]) == external
    # one that breaks off before the first rename is undone
    monkeypatch.setattr(store, "rename", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        e.sql(f"DELETE FROM {t} WHERE id = 4")
    monkeypatch.setattr(store, "rename", rename)
    assert e.recover(t) == "undone" and spark.table(t).count() == 5


def test_update_semantics(spark):
    e = Engine(spark)
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], "name string, age int, job string").createOrReplaceTempView("p01")
    spark.createDataFrame([("a", 10, "k"), (None, 20, "l"), ("c", 30, "m")], "name string, age int, job string").createOrReplaceTempView("p0")
    text = "UPDATE p01 SET age = p01.age + p0.age, job = concat(p0.job, p01.age) FROM p0 WHERE p01.name = p0.name"
    assert sorted(tuple(r)[:3] for r in e.sql(text).collect()) == [("a", 11, "k1"), ("a", 12, "k2")]
    assert sorted((tuple(r) for r in e.merged(text).collect()), key=str) == sorted([("a", 11, "k1"), ("a", 12, "k2"), (None, 3, "z"), ("b", None, "w")], key=str)
    spark.createDataFrame([("a", 1), ("a", 2)], "name string, v int").createOrReplaceTempView("twice")
    with pytest.raises(Exception, match="several source rows"):
        e.merged("UPDATE p01 SET age = t.v FROM twice t WHERE p01.name = t.name").collect()
    with pytest.raises(store.AnalysisError):
        e.merged("UPDATE p01 SET age = t.v FROM twice t WHERE p01.name = t.name", "first")
    first = e.merged("UPDATE p01 SET age = t.v FROM twice t WHERE p01.name = t.name", "first", "t.v DESC").collect()
    assert sorted((tuple(r) for r in first), key=str) == sorted([("a", 2, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], key=str)
    assert e.merged("UPDATE p01 SET age = t.v FROM twice t WHERE p01.name = t.name", "duplicate").count() == 6
    with pytest.raises(store.AnalysisError):
        e.sql("UPDATE p01 SET nothing = 1 FROM p0 WHERE p01.name = p0.name")


def test_swap_keeps_backup_and_properties(spark):
    e = Engine(spark)
    spark.range(5).selectExpr("id", "id % 2 AS p").write.partitionBy("p").mode("overwrite").saveAsTable("swapped")
    spark.sql(f"ALTER TABLE swapped SET TBLPROPERTIES ('{store.STORAGE_TYPE}' = 'es')")
    e.sql("DELETE FROM swapped WHERE id = 3")
    assert sorted(r.id for r in spark.table("swapped").collect()) == [0, 1, 2, 4]
    assert store.properties(spark, "swapped")[store.STORAGE_TYPE] == "es" and store.indexed(spark, "swapped")
    backup = next(t.name for t in spark.catalog.listTables() if t.name.startswith("swapped__backup"))
    assert spark.table(backup).count() == 5


def test_snapshot_errors(spark):
    e = Engine(spark)
    spark.range(3).write.mode("overwrite").saveAsTable("unparted")
    for text in ("MAKE SNAPSHOT s1 FROM unparted PARTITION (id = 1)", "MAKE SNAPSHOT unparted FROM unparted"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            e.sql(text)


def test_training_reaches_the_optimum(spark, tmp_path):
    e, rng = Engine(spark), random.Random(1)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    rows = [(a, b, int(a - b + rng.gauss(0, 1) > 0)) for a, b in rows]
    spark.createDataFrame(rows, "a double, b double, label int").createOrReplaceTempView("points")
    e.sql(f"TRAIN MODEL LogisticRegression FROM points INTO '{tmp_path}/m'")
    meta = models.described(spark, f"{tmp_path}/m")
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    w, c = np.array(meta["coefficients"]), np.array(meta["intercepts"])
    p = np.exp(x @ w.T + c)
    p /= p.sum(1, keepdims=True)
    assert np.abs((p - np.eye(2)[y]).T @ x + w).max() < 1e-2
    e.sql(f"REGISTER MODEL LogisticRegression FROM '{tmp_path}/m' AS guess")
    got = [r[0] for r in spark.sql("SELECT guess((a, b)) FROM points").collect()]
    assert got == (x @ w.T + c).argmax(1).tolist()
    with pytest.raises(store.AnalysisError):
        e.sql(f"TRAIN MODEL XGB FROM points INTO '{tmp_path}/n'")


def test_keyed_source(spark, tmp_path):
    path = f"{tmp_path}/k"
    df = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) AS rk", "id AS v", "id * 2 AS w")
    keyed.write_keyed(df, path, "rk")
    read = keyed.scan(spark, path, "rk")
    assert read.count() == 1000
    assert sorted(r.v for r in read.filter("rk LIKE 'k012%'").collect()) == list(range(120, 130))
    pruned = keyed.scan(spark, path, "rk", ["v"], "rk >= 'k0990' AND w > 1990")
    assert sorted(r.v for r in pruned.collect()) == [996, 997, 998, 999]
    assert keyed.scan(spark, path, "rk", ["v"], "rk = 'k0007'").collect()[0].v == 7
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.format("quern_keyed").option("path", "x").load()
    assert keyed.column_mapping(":key,f:a", ["rk", "a", "b"]) == [("", "key", "rk"), ("f", "a", "a")]


def test_filters_skip_files_and_columns(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    path = f"{tmp_path}/k"
    keyed.write_keyed(spark.range(1000).selectExpr("id", "id AS v"), path, "id")
    reader = lambda: keyed.KeyedSource({"path": path, "key": "id"}).reader(T.StructType([T.StructField("id", T.LongType())]))
    counts = []
    for filters in ([], [EqualTo(("id",), 5)], [In(("id",), (1, 2, 999))], [GreaterThan(("id",), 900), LessThan(("id",), 950)], [EqualTo(("v",), 5)]):
        r = reader()
        assert list(r.pushFilters(filters)) == filters
        counts.append(len([p for p in r.partitions() if p.value]))
    assert counts == [8, 1, 2, 1, 8]
    r = reader()
    assert {b.schema.names[0] for p in r.partitions() for b in r.read(p)} == {"id"} and all(b.num_columns == 1 for p in r.partitions() for b in r.read(p))


def test_upserts_rewrite_the_ranges_they_hit(spark, tmp_path):
    path = f"{tmp_path}/k"
    keyed.write_keyed(spark.range(800).selectExpr("id", "id AS v"), path, "id")
    before = {f["file"] for f in keyed._files(spark, path)}
    new = [(5, -1, 1), (5, -2, 2), (900, -3, 1), (None, -4, 1)]
    for order in (new, new[::-1]):
        keyed.upsert(spark, path, spark.createDataFrame(order, "id long, v long, n int"), "id", "n")
        found = {r.id: r.v for r in keyed.read(spark, path).collect()}
        assert len(found) == 801 and (found[5], found[900], found[6]) == (-2, -3, 6)
    after = {f["file"] for f in keyed._files(spark, path)}
    assert len(before & after) == len(before) - 2
    assert keyed.vacuum(spark, path, 1) >= 1 and keyed.read(spark, path).count() == 801


def test_arrow_round_trip(spark):
    df = spark.range(250).selectExpr("id", "CAST(id AS INT) AS k")
    assert arrow.from_ipc(arrow.to_ipc(df, 200)).num_rows == 200


def test_stream_upserts(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, n int").write.parquet(source)
    merge = streams.upsert_batches(table, "id", "n")

    def run():
        q = spark.readStream.schema("id long, v string, n int").parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None

    run()
    spark.createDataFrame([(2, "old", 2), (2, "new", 3), (3, "c", 1)], "id long, v string, n int").write.mode("append").parquet(source)
    run()
    assert sorted((r.id, r.v) for r in keyed.read(spark, table).collect()) == [(1, "a"), (2, "new"), (3, "c")]
    merge(spark.createDataFrame([(2, "again", 9)], "id long, v string, n int"), 1)  # a batch that comes again
    assert sorted((r.id, r.v) for r in keyed.read(spark, table).collect()) == [(1, "a"), (2, "new"), (3, "c")]


def test_keyed_scan_reads_the_keyed_source(spark):
    df = queries.QUERIES["keyed_source_scan"](spark, "/root/testdata/sf0.001")
    assert "quern_keyed" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.event_id for r in df.collect()) == sorted(r.event_id for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id BETWEEN 100 AND 200").collect())
