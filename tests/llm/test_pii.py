"""Personal data: time on very long texts, and the estimate, the classifier and the query's spans against brute force."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm import pii, queries

M = 1_000_000
LONG = {
    "at": "dot " + "at" * (M // 2), "letters": "dot " + "y" * M, "digits": "1" * M, "spaced at": " at" * (M // 3) + " dot ", "dots": "a at b" + " dot c" * (M // 6), "runs of digits": ("1" * 1000 + ".") * (M // 1000),
    "no end": "+1" + "-" * M, "signs": "a@" * (M // 2), "no dot": "a@" + "a" * M, "key": "aB3" * (M // 3), "brackets": "x (at) " * (M // 7) + "dot",
}


@pytest.mark.parametrize("name", LONG)
def test_a_million_characters_take_under_two_seconds(name):
    began = time.process_time()
    pii.candidates(LONG[name])
    assert time.process_time() - began < 2


def test_spelled_addresses():
    text = "mail joe.x at host dot com or me [at] x (dot) y [dot] org, a at at at b dot c; look at this dot product, " + "l" * 65 + " at a dot b"
    assert [text[a:b] for _, a, b in pii._spelled(text)] == ["joe.x at host dot com", "me [at] x (dot) y [dot] org", "at at b dot c", "look at this dot product"]
    spans = [("x", 0, 5), ("x", 4, 9), ("x", 12, 14), ("x", 30, 40)]
    rng = random.Random(1)
    for _ in range(300):
        taken = [("t", a := rng.randrange(40), a + rng.randrange(1, 9)) for _ in range(rng.randrange(5))]
        assert pii._apart(spans, taken) == [s for s in spans if not any(s[1] < y and x < s[2] for _, x, y in taken)]


def texts():
    rng = random.Random(9)
    some = ["call 555-201-7788 now", "version 555-201-7788", "ssn: 536-22-1845", "id 000-11-2222", "token = sk-9fK2mQ7xLp0aZr4T", "sha 9f86d081884c7d659a2feaa0c55ad015", "mail bob at corp dot com", "look at this dot product", "a@b.org", "+1 (988) 555-2485", "10.0.3.200", "4111 1111 1111 1111", "plain words only", None, ""]
    return [None if x is None else f"{x} {rng.choice(['', 'and so on', 'key', 'a@c.net'])}" for x in rng.choices(some, k=160)]


def brute_posteriors(found, rounds=60):
    """Expectation-maximisation over single candidates, with plain loops."""
    out = {}
    for kind in pii.KINDS:
        own = [c for c in found if c.kind == kind]
        q = [1 / (1 + math.exp(-sum(c.votes))) for c in own]
        for _ in range(rounds if own else 0):
            prior = (sum(q) + 1) / (len(own) + 2)
            rate = {}
            for j in range(len(pii.LABELERS)):
                for c, hoped in ((1, {-1: 1, 0: 2, 1: 4}), (0, {-1: 4, 0: 2, 1: 1})):
                    seen = {v: hoped[v] + sum((x if c else 1 - x) for x, o in zip(q, own, strict=True) if o.votes[j] == v) for v in (-1, 0, 1)}
                    rate.update({(j, c, v): seen[v] / sum(seen.values()) for v in seen})
            odds = [math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(o.votes)) for o in own]
            q = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]
        out.update({o.pattern: x for o, x in zip(own, q, strict=True)})
    return out


def brute_weights(counts, posterior):
    rows = [pii.SpanModel._row(p) for p in counts]
    total = sum(math.sqrt(n) for n in counts.values())
    weights = [0.0] * len(rows[0])
    for _ in range(400):
        step = [0.0] * len(weights)
        for row, (p, n) in zip(rows, counts.items(), strict=True):
            miss = math.sqrt(n) / total * (posterior[p] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, weights, strict=True)))))
            for k, x in enumerate(row):
                step[k] += x * miss
        weights = [w + 4.0 * (s - 1e-4 * w) for w, s in zip(weights, step, strict=True)]
    return weights


def test_estimate_classifier_and_spans_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    found = {i: pii.candidates(t) for i, t in rows}
    counts = {}
    for c in (c for i in found for c in found[i]):
        counts[c.pattern] = counts.get(c.pattern, 0) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.pattern: r.n for r in pii.vote_counts(docs).collect()} == counts
    model, posterior = pii.SpanModel(counts), brute_posteriors([c for i in found for c in found[i]])
    assert model.posterior.keys() == posterior.keys() and all(abs(model.posterior[p] - posterior[p]) < 1e-9 for p in posterior)
    weights = brute_weights(counts, posterior)
    assert np.allclose(model.weights, weights, atol=1e-7)

    def spans(i):
        own = found[i]
        likely = lambda c: 1 / (1 + math.exp(-sum(a * b for a, b in zip(pii.SpanModel._row(c.pattern), weights, strict=True))))
        more, end = [], -1
        for c in sorted((c for c in own if not c.base and sum(v > 0 for v in c.votes[:4]) >= 2 and likely(c) >= 0.5), key=lambda c: (c.start, -c.end)):
            if c.start >= end:
                more.append(c)
                end = c.end
        told = lambda cs: ",".join(f"{c.kind}:{c.start}:{c.end}" for c in sorted(cs, key=lambda c: (pii.KINDS.index(c.kind), c.start)))
        base = [c for c in own if c.base]
        return hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)

    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    assert {i: (r.base_sha256, r.spans) for i, r in got.items()} == {i: spans(i) for i, _ in rows}
    added = {s.split(":")[0] for r in got.values() for s in r.spans.split(",") if s} - set(pii.KINDS[:4])
    assert added == {"secret", "ssn"} and any(re.search("phone", r.spans) and r.n_phone == 0 for r in got.values())
