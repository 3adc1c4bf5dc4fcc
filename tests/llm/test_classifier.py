"""The vote against plain loops, ties, and odd rows by value."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.llm import quality_classifier as Q
from quern.llm import queries, tokens as K

SF = "/root/testdata/sf0.001"


def brute_scores(voters, texts):
    """One text at a time, one voter at a time."""
    out = []
    for text in texts:
        row = Q._weighted(Q.features(*K.raw(pa.array([text], pa.large_string()))), voters.idf)[0].astype(np.float64) @ voters.space.astype(np.float64)
        row /= max(np.linalg.norm(row), 1e-9)
        cosines = [float(row @ v) for v in voters.vectors.astype(np.float64)]
        near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: Q.NEAREST]
        votes = [(max(cosines[k], 1e-6) ** 4 * float(voters.weights[k]), float(voters.labels[k])) for k in near]
        out.append(sum(v * y for v, y in votes) / sum(v for v, _ in votes))
    return out


def test_query_against_plain_loops(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()[:150]
    extra = [(90_001, None), (90_002, ""), (90_003, "x " * 40_000), (90_004, docs[0]["text"])]
    docs += [{"doc_id": i, "text": t} for i, t in extra]
    pq.write_table(pa.table({"doc_id": [r["doc_id"] for r in docs], "text": pa.array([r["text"] for r in docs], pa.string())}), tmp_path / "documents.parquet")
    spark.createDataFrame([(r["doc_id"], k * 7 % 3 % 2, 0) for k, r in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, labels = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    voters = Q.fitted(table, labels.filter(~held_out))
    wanted = dict(zip([r["doc_id"] for r in docs], brute_scores(voters, [r["text"] for r in docs]), strict=True))
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, str(tmp_path)).collect()}
    # equal cosines of rows that differ in nothing are put in order by their place; others may differ by rounding at the edge of the nearest
    assert got.keys() == wanted.keys() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([abs(got[i].score - wanted[i]) < 1e-4 for i in wanted]) > 0.98
    assert abs(got[90_004].score - got[docs[0]["doc_id"]].score) < 1e-5 and abs(got[90_001].score - got[90_002].score) < 1e-9


def test_ties_go_to_the_first():
    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert [sorted(r) for r in Q._nearest(cosines, 3).tolist()] == [[0, 1, 2], [0, 1, 2]]
    rng = np.random.default_rng(3)
    many = rng.integers(0, 6, (200, 40)).astype(np.float32)
    for row, near in zip(many, Q._nearest(many, 7), strict=True):
        assert sorted(near.tolist()) == sorted(sorted(range(40), key=lambda k: (-row[k], k))[:7])


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels, share in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.5), ([(1, None)], 0.5)):
        voters = Q.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in Q.scored(docs, voters).collect()} == {share}
