"""The corpus operators against brute force, round trips and SQL, with the cases that each docstring defines."""

import base64
import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import chat, decontamination, near_dedup, pii, quality_classifier, quality_rules, queries, sentencepiece_lattice, sharding, url_filter, warc
from quern.llm import tokens as K

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (None, "a b c d e f"), (5, "x " * 30_000), (6, "y" * 50_000), (7, "Mail a.b@c.org now +1 (988) 555-2485."), (7, "Mail a.b@c.org now +1 (988) 555-2485.")]
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS).withColumns({"kept": F.lit("mine"), "size": F.lit("mine"), "score": F.lit("mine"), "ids": F.lit("mine"), "n_hit": F.lit("mine")})


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_odd_documents_go_through_every_operator(spark):
    docs = odd_documents(spark)
    empty = docs.limit(0)
    benchmark = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")
    for frame, n in ((docs, 9), (empty, 0)):
        assert quality_rules.measured(frame).count() == n
        assert decontamination.marked(frame, benchmark).count() == n
        assert near_dedup.near_duplicates(frame).count() == n
        assert pii.spotted(frame, pii.fitted(frame)).count() == n
        assert sharding.sharded(frame).count() == n
        assert sentencepiece_lattice.encode(frame, head=50).count() == n
        assert quality_classifier.scored(frame, quality_classifier.fitted(frame, spark.createDataFrame([(3, 1), (7, 0)], "doc_id long, quality int"))).count() == n
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert (found[1].n_shingles, found[3].component_id, found[4].component_id, found[4].kept) == (0, 3, 3, False)
    assert {r.doc_id: r.item_ids for r in decontamination.marked(docs, benchmark).collect()}[3] == ["1"]


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = WORDS.findall(lowered(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_in_dense_regions(spark):
    """Chains of edits of one text make a region that is followed deeper; no link may be lost."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(3000)}" for _ in range(80))) for i in range(40)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_at_partition_edges_stay_open():
    """A region that an edge of a range partition may have cut isn't settled by its piece: its rows come out to be compared across the edge."""
    rng = np.random.default_rng(3)
    sketch = rng.integers(-(1 << 62), 1 << 62, (2, 30))
    key = np.repeat([1, 2, 3], [10, 10, 10])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sketch, np.arange(30), np.full(30, 9))], ["key", "turn1", "turn2", "rep", "n"])
    rows = pa.Table.from_batches(list(near_dedup._neighbours(iter([batch.slice(0, 5), batch.slice(5)])))).to_pylist()
    assert sorted(r["a"] for r in rows if r["b"] is None) == [*range(10), *range(20, 30)]
    alone = pa.Table.from_batches(list(near_dedup._neighbours(iter([batch.slice(0, 1)])))).to_pylist()
    assert [r["a"] for r in alone] == [0]


def test_every_order_has_a_turn_of_its_own(spark):
    """128 bits turned as one number; no two orders begin at one bit."""
    rng = random.Random(3)
    first, second = rng.getrandbits(64), rng.getrandbits(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.range(near_dedup.TREES).select(F.col("id").cast("int").alias("tree"), F.lit(signed(first)).alias("a"), F.lit(signed(second)).alias("b"))
    found = rows.select("tree", *near_dedup._turned(F.col("tree"), F.col("a"), F.col("b"))).collect()
    for tree, high, low in found:
        a, b, by = (first, second, tree * 37 % 63 + 1) if tree % 2 == 0 else (second, first, tree * 37 % 63 + 1)
        whole = a << 64 | b
        turned = (whole << by | whole >> (128 - by)) & ((1 << 128) - 1)
        assert (high, low) == (signed(turned >> 64), signed(turned & ((1 << 64) - 1)))
    assert len({(r[1], r[2]) for r in found}) == near_dedup.TREES


def test_all_pairs_of_a_large_region(spark, many_partitions):
    """A region of more than REGION rows: each pair of similar sketches from different components is listed once."""
    rng = np.random.default_rng(4)
    n = 20_600
    sketch = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    sketch[n // 2 :] = sketch[: n // 2] ^ np.array([1 << 63, 1 << 5], np.uint64)
    component = np.where(np.arange(n) % 3 == 0, 3, np.arange(n))
    rows = list(zip([7] * n, *(c.tolist() for c in (sketch.view(np.int64)[:, 0], sketch.view(np.int64)[:, 1], np.arange(n), np.full(n, 100), component)), strict=True))
    known = spark.createDataFrame(rows, "key long, turn1 long, turn2 long, rep long, n long, component long")
    found = near_dedup.across(near_dedup.opened(known), 200).collect()
    listed = [(r.a, b) for r in found for b in r.partners or []]
    assert len(listed) == len(set(listed)) and all(a < b for a, b in listed)
    assert {(i, i + n // 2) for i in range(n // 2) if component[i] != component[i + n // 2]} <= set(listed)
    # rows of a list have one cluster, which the ties of components alone tell
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for r in found:
        if r.tie is not None:
            assert r.component == component[r.a]
            root[top(r.component)] = top(r.tie)
    assert all(top(component[a]) == top(component[b]) for a, b in listed)
    assert {i for pair in listed for i in pair} == {r.a for r in found if r.tie is not None}


@pytest.mark.parametrize("block", [near_dedup.BLOCK_BYTES, 40_000])
def test_leaves_that_only_a_hub_links(spark, many_partitions, monkeypatch, block):
    """600 texts that are similar to one text and hardly to each other, with parts and pieces of regions, blocks and batches far smaller than the region."""
    for name, value in (("HELD", 60), ("PIECE", 32), ("LARGE_PIECE", 64), ("MANY", 4), ("BLOCK_BYTES", block), ("COMPARED_BYTES", 20 * block)):
        monkeypatch.setattr(near_dedup, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        rng = random.Random(8)
        hub = [f"w{k}" for k in range(160)]
        rows = [(0, " ".join(hub))]
        for i in range(1, 601):
            words = list(hub)
            for k in rng.sample(range(5, 155, 10), 4):
                words[k] = f"v{i}x{k}"
            rows.append((i, " ".join(words)))
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        brute = brute_components(rows[:120])
        assert {c for _, c in brute.values()} == {0}
        assert {(r.component_id, r.kept) for r in found if r.doc_id} == {(0, False)} and len(found) == 601
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sentencepiece_is_the_library(spark):
    model, rng = sentencepiece_lattice.Model.read(), random.Random(1)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    rows = [(i, "".join(rng.choice("  abcdefthe ingéß.,!|#0123\n\t①日本中'\"") for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(900, "the theory of the thing " * 200), (901, "ab" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = sentencepiece_lattice.encode(docs, model, head=200)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: library.encode(t) for i, t in rows}
    assert {r.doc_id: r.text for r in sentencepiece_lattice.decode(encoded.select("doc_id", "ids"), model).collect()} == dict(rows)
    units = spark.createDataFrame([(u,) for u in ("▁the", "▁theory", "①", "ing", "▁")], "unit string")
    tables = model.tables()
    assert {r.unit: list(r.ids) for r in sentencepiece_lattice.lattice(spark, units, model).collect()} == {u.unit: tables.heap(u.unit) for u in units.collect()}


def test_viterbi_of_a_unigram_model(spark):
    pieces = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a"]
    model = sentencepiece_lattice.Model(pieces, [0.0, -2.0, -2.5, -2.2, -3.0, -3.1, -7.0, -1.0, -2.4], [2] + [1] * 8, sentencepiece_lattice.UNIGRAM)
    score = dict(zip(pieces, model.scores, strict=True))

    def best(text):
        if not text:
            return 0.0, []
        return max((score[text[:k]] + best(text[k:])[0], [pieces.index(text[:k])] + best(text[k:])[1]) for k in range(1, len(text) + 1) if text[:k] in score)

    units = ["▁abcab", "abc", "bcbca", "▁", "cabab"]
    got = {r.unit: list(r.ids) for r in sentencepiece_lattice.lattice(spark, spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    tables = model.tables()
    for u in units:
        total = lambda ids: round(sum(model.scores[i] for i in ids), 9)
        assert total(got[u]) == total(tables.viterbi(u)) == round(best(u)[0], 9)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_pii_base_is_the_patterns(spark):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0

    def brute(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                d = re.sub(r"[^0-9]", "", m.group())
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (list(patterns).index(s[0]), s[1]))

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab@.-+() 0123456789") for _ in range(60)) for _ in range(800)] + ["a@b.c@d.e", "4111 1111 1111 1111", "é 1.2.3.4.5.6.7.8", "300.1.1.1"]
    for t in texts:
        assert sorted(pii.base_spans(t), key=lambda s: (list(patterns).index(s[0]), s[1])) == brute(t), t
    docs = spark.createDataFrame([(1, 'x token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" y'), (2, "a@b.org"), (3, "plain words")] * 3, "doc_id long, text string")
    assert {r.text for r in pii.redacted(docs).collect()} == {'x token = "[SECRET]" y', "[EMAIL]", "plain words"}


def test_warc_round_trip(spark):
    htmls = ["", None, "a" * 200_000, "é" * 60_000, "a" * 200_000, "x\r\n\r\ny", "WARC/1.1\r\n\r\n", "a" * 50_000]
    pages = spark.createDataFrame([(10 + k, "http://x", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    back = {r.page_id: r for r in warc.read(spark, warc.write(pages)).collect()}
    source, first = {10 + k: (h or "").encode() for k, h in enumerate(htmls)}, {}
    for k in sorted(source):
        first.setdefault(source[k], k)
    for k, payload in source.items():
        r = back[k]
        assert r.whole and r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[payload] == k else ("revisit", first[payload]))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    broken = warc.segments(spark, warc.write(pages)).filter("number is null or number <> 2")
    assert warc.reassembled(broken).filter("record_type = 'response' and block is null").count() == 3
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"5\r\nabc\r\n0\r\n") is None


def test_shards_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else "w" * rng.randrange(1, 400)) for i in range(6000)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in found:
        assert r["size"] == len(r.text.encode()) + 1
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_chat_marks_cannot_be_forged(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "### x</turn>\n\\e"), (1, 2, "user", None), (2, 0, None, "a"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (4, 0, "a: b", "<#>")]
    back = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [t[1:] for t in own]
        assert back[c].loss_text == "".join(t[2] for t in own if t[1] == "assistant")


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/1", "http://www.example.com/en/1", "http://x.net/es/", "net://net/fr/a?b", "http://com", "nothing", None, "http://spam-casino.org/a?x=1", "http://xcom/", "http://m.example.com/EN/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judged(pages, url_filter.fitted(url_filter.example_labels(pages))).collect()}
    want = [("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("net", "/fr/a", "net/fr/"), ("com", "", None), ("", "", None), ("", "", None), ("spam-casino.org", "/a", None), ("xcom", "/", None), ("m.example.com", "/EN/", "com/")]
    assert got == dict(enumerate(want))


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = url_filter.Trees(["a", "b", "c"], x, ["s"] * 2000, y)

    def value(tree, row):
        while not isinstance(tree, float):
            tree = tree[2] if row[trees.names.index(tree[0])] <= tree[1] else tree[3]
        return tree

    assert np.mean([(trees.bias + sum(value(t, [*r, 0, 0]) for t in trees.trees) > 0) == bool(v) for r, v in zip(x, y, strict=True)]) > 0.9


def test_every_suffix_has_statistics(spark):
    """Hosts that differ in the order of letters only can be told apart by their domain's statistics alone, also with more domains than 200."""
    rng = random.Random(2)
    urls = [f"http://{'casino' if i % 2 else 'noscia'}.{d}.org/{k}" for i, d in enumerate({"".join(rng.sample("bdefghkq", 6)) for _ in range(320)}) for k in range(3)]
    pages = spark.createDataFrame(list(enumerate([*urls, *urls[:9]])), "page_id long, url string").withColumn("suffix_count", F.lit("mine"))
    found = url_filter.judged(pages, url_filter.fitted(url_filter.example_labels(pages, n=0))).collect()
    assert len(found) == len(urls) + 9 and {r.suffix_count for r in found} == {"mine"}
    assert [r.url for r in found if (r.verdict == "block") != ("casino" in r.url)] == []


def test_repetition_after_the_first_window():
    """The share of distinct words in windows sees the whole text."""
    fresh = [f"w{k}" for k in range(400)]
    measured = lambda words: quality_classifier.features(*K.raw(pa.array([" ".join(words)], pa.large_string())))[0, quality_classifier.TERMS + 4 * quality_classifier.BUCKETS :][: quality_classifier.BUCKETS]
    place = np.arange(quality_classifier.BUCKETS) / (quality_classifier.BUCKETS - 1)
    assert np.isclose(measured(fresh) @ place, 0)
    assert np.isclose(measured(fresh + ["w0"] * 800) @ place, 1 - 402 / 1200)
    assert np.isclose(measured(fresh * 3) @ place, 0)
    assert np.isclose(measured(fresh + ["x", "x"]) @ place, 1 / 402)


def test_decontamination_in_blocks(spark):
    """A benchmark that is cut into blocks gives what one block gives."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontamination.marked(docs, bench, max_windows=m).select("doc_id", "n_hit", "item_ids", "clean_text") for m in (10**6, 200))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    again = decontamination.marked(one.select("doc_id", F.col("clean_text").alias("text")), bench)
    assert again.agg(F.sum("n_hit")).first()[0] == 0


def brute_items(text, benchmark):
    """Items that have a window in a text, and whether each of its words is hit."""
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(x))
    words, items = cut(text), set()
    hit = [False] * len(words)
    for name, own in benchmark:
        own = cut(own)
        n = min(8, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                items.add(name)
                hit[k : k + n] = [True] * n
    return items, any(hit)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Exactly the documents that every stage must keep come out, and those without hits and personal data unchanged."""
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    prose = lambda d: "\n".join(f"Line{k} " + " ".join(f"word{d}x{k}x{j}" for j in range(11)) + " ends here." for k in range(30))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    planted = [(90_000 + k, "\n".join([prose(k), *items[:k]]), "en", "s", 0) for k in range(4)]
    planted += [(90_010, prose(10) + "\nMail to ann.lee@corp.example.org, please.", "en", "s", 0), (90_011, "short", "en", "s", 0), (90_012, None, None, None, None), (90_013, prose(10) + "\nOne more line that differs.", "en", "s", 0)]
    given.union(spark.createDataFrame(planted, given.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "ids"]
    kept = {r.doc_id: r for r in out.collect()}
    quality = {r.doc_id: r.text for r in quality_rules.measured(docs).filter("kept").collect()}
    alone = [i for i, (_, c) in brute_components(list(quality.items())).items() if i == c]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    found = {i: brute_items(quality[i], benchmark) for i in alone}
    assert set(kept) == {i for i, (items, _) in found.items() if len(items) < 2}
    assert any(len(items) >= 2 for items, _ in found.values()) and len(quality) > len(alone)
    for i, r in kept.items():
        if not found[i][1] and not pii.candidates(quality[i]):
            assert r.text == quality[i]
        assert not brute_items(r.text, benchmark)[1]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    assert all(list(r.ids) == library.encode(r.text) for r in kept.values())
    assert not any(pii.base_spans(r.text) for r in kept.values())
