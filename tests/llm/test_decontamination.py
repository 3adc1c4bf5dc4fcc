"""Hits against brute force, in one block and in many, and odd rows by value."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, benchmark):
    words, items, hit = cut(text), set(), set()
    for name, own in benchmark:
        own = cut(own)
        n = min(8, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                items |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("most", [decontamination.MAX_WINDOWS, 40])
def test_against_brute_force(spark, most):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha Beta gamma delta é42 日本 x1 y".split())
    benchmark = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 9, 20])))) for k in range(30)]
    benchmark += [(100, None), (101, ""), (None, "lone words of an item without a name here"), (3, benchmark[3][1]), (200, benchmark[5][1])]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += [None, "", "!!", benchmark[5][1], "Lone WORDS of an item without a name here", "beta, " * 20_000, "z" * 50_000] + [f"{benchmark[9][1]}; {benchmark[4][1]}"] * 40
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, hits string").withColumn("more", F.lit("stays"))
    found = decontamination.marked(docs, spark.createDataFrame(benchmark, "item_id long, text string"), max_windows=most)
    assert found.columns == ["doc_id", "text", "more", "n_words", "n_hit", "item_ids", "hits", "clean_text"]
    rows = {r.doc_id: r for r in found.collect()}
    assert {i: (r.n_words, r.n_hit, list(r.item_ids)) for i, r in rows.items()} == {i: brute(t, benchmark) for i, t in enumerate(texts)}
    for i, r in rows.items():
        assert (r.clean_text is None) == (texts[i] is None) and sum(s.end - s.start for s in r.hits) == r.n_hit
        assert r.n_hit or r.clean_text == texts[i]
    assert decontamination.marked(docs.limit(0), spark.createDataFrame(benchmark, "item_id long, text string"), max_windows=most).count() == 0


def test_an_empty_benchmark_leaves_all_clean(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.item_ids) for r in decontamination.marked(docs, empty).collect()] == [(0, []), (0, [])]
