"""Shards against brute force over the sorted keys."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, sharding


def rows():
    some = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i} " * (1 + i * i % 97)) for i in range(1, 1500)]
    return some + [(5000, None), (5001, ""), (None, "no id"), (None, "no id"), (5002, "long " * 5000), (5003, "é" * 300), (7, "text 7 " * (1 + 49))]


def brute(docs, shards=8, tolerance=sharding.TOLERANCE):
    """Sorted keys, and every cut that a target admits: within the tolerance, or the nearest there is."""
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.xxhash64(body).alias("h"), F.xxhash64(F.col("doc_id"), F.crc32(body.cast("binary"))).alias("g")).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    keys = sorted({(r.h, r.g) for r in keyed})
    bytes_of = dict.fromkeys(keys, 0)
    for r in keyed:
        bytes_of[r.h, r.g] += size(r)
    below, n = {}, 0
    for k in keys:
        below[k] = n
        n += bytes_of[k]
    admitted = []
    for t in (n * k // shards for k in range(1, shards)):
        least = min(abs(x - t) for x in below.values())
        admitted.append({k for k in keys if abs(below[k] - t) <= max(least, tolerance * n / shards)})
    return {(r.doc_id, r.text): (r.h, r.g) for r in keyed}, admitted


@pytest.mark.parametrize("range_bytes", [sharding.RANGE_BYTES, 900])
def test_shards_against_brute_force(spark, tmp_path, range_bytes):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"size": F.lit("mine"), "more": F.lit("stays")})
    key_of, admitted = brute(docs)
    found = sharding.sharded(docs, range_bytes=range_bytes).collect()
    assert len(found) == len(rows()) and {r.more for r in found} == {"stays"}
    for r in found:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    shards = [sorted((r for r in found if r.shard == s), key=lambda r: r.slot) for s in range(8)]
    assert sum(map(len, shards)) == len(found)
    assert all([r.slot for r in own] == list(range(len(own))) for own in shards)
    order = [key_of[r.doc_id, r.text] for own in shards for r in own]
    assert order == sorted(order)  # shards and slots follow the keys
    for own, allowed in zip(shards[1:], admitted, strict=True):
        assert key_of[own[0].doc_id, own[0].text] in allowed
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows()], pa.int64()), "text": pa.array([t for _, t in rows()], pa.string())}), tmp_path / "documents.parquet")
    same = {(r.doc_id, r.slot, r.shard, r.text_crc32) for r in queries.op6_sharding(spark, str(tmp_path)).collect()}
    assert same == {(r.doc_id, r.slot, r.shard, r.text_crc32) for r in found}


def test_one_key_that_no_cut_divides(spark):
    """Rows with equal id and text stay together; the search ends all the same."""
    docs = spark.createDataFrame([(1, "same " * 40)] * 300 + [(k, f"t{k}") for k in range(2, 20)], "doc_id long, text string")
    found = sharding.sharded(docs).collect()
    assert len({r.shard for r in found if r.doc_id == 1}) == 1 and len(found) == 318
    assert sharding.sharded(docs.limit(0)).count() == 0
