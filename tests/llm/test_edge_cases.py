"""The cases that the operators' docstrings define: nulls in any column, empty tables, repeated rows, ties, clashing names."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, near_dedup, pii, quality_rules, sentencepiece_lattice, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "\n".join(f"Line{k} " + " ".join(f"word{k}x{j}" for j in range(11)) + " ends here." for k in range(9))


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def test_quality_rules_of_odd_rows(spark):
    docs = documents(spark, (1, None), (2, ""), (3, PROSE), (3, PROSE), (None, PROSE), (4, " \n\t\n"), (5, "x " * 40_000), (6, "y" * 60_000)).withColumns({"kept": F.lit("mine"), "N_Words": F.lit("mine"), "more": F.lit("stays")})
    rows = quality_rules.measured(docs).collect()
    assert len(rows) == 8
    assert all(r.more == "stays" and isinstance(r.kept, bool) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [(by[i].n_words, by[i].base_failed, by[i].kept, by[i].clean_text) for i in (1, 2, 4)] == [(0, True, False, "")] * 3
    assert by[3].kept and by[None].kept and by[3].clean_text == PROSE
    assert (by[5].n_words, by[5].n_repeat_words, by[5].kept) == (40_000, 40_000, False)
    assert (by[6].n_words, by[6].word_chars, by[6].kept) == (1, 60_000, False)
    assert sorted(r.doc_id or 0 for r in quality_rules.accepted(docs).collect()) == [0, 3, 3]
    assert quality_rules.accepted(docs).columns == docs.columns


def test_a_filter_on_the_verdict_measures_once(spark):
    """The measures must not be computed again for every use that a pushed filter makes of them."""
    plan = quality_rules.accepted(documents(spark, (3, PROSE)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_warc_of_odd_pages(spark):
    rows = [(7, "http://a", "same"), (7, "http://a", "same"), (3, None, "same"), (None, "http://b", "same"), (9, "http://c\r\nWARC-Type: x", None), (2, "http://d", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("mine"), "record_type": F.lit("mine")})
    back = warc.read(spark, warc.write(pages)).collect()
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in back)
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    same, empty = digest(b"same"), digest(b"")
    assert found == sorted([(0, "revisit", 3, 4, same), (2, "response", 0, 0, empty), (3, "response", 0, 4, same), (7, "revisit", 3, 4, same), (7, "revisit", 3, 4, same), (9, "revisit", 2, 0, empty)])
    assert all(r.whole for r in back)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_chat_of_odd_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "assistant", "no number"), (1, 0, "assistant", "tie b"), (1, 0, "assistant", "tie a"), (2, 0, "assistant", "long " * 30_000), (3, 0, None, None)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"t": F.lit("mine"), "formatted": F.lit("mine"), "turns": F.lit("mine")})
    back = {r.conv_id: r for r in chat.read_back(chat.examples(talks)).collect()}
    assert [t.text for t in back[1].turns] == ["no number", "tie a", "tie b"] and back[1].loss_text == "no numbertie atie b"
    assert [tuple(t) for t in back[None].turns] == [("user", "a"), ("assistant", "b")]
    assert back[2].loss_text == "long " * 30_000
    assert ([tuple(t) for t in back[3].turns], back[3].loss_text) == ([("", "")], "")
    assert chat.examples(talks.limit(0)).count() == 0
    assert chat.digest(chat.read_back(chat.examples(talks.limit(0)))).count() == 0


def test_every_reply_is_trained_once(spark):
    """Each example trains one reply only and shows exactly the turns before it."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(7)]
    found = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    told = [f"{chat.OPEN}{r}: {t}{chat.END}" for _, _, r, t in rows]
    assert [r.formatted for r in found] == ["".join(told[:2]), "".join(told[:4]), "".join(told[:6]), "".join(told)]
    assert [r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in found] == ["turn 1", "turn 3", "turn 5", None]


def test_urls_of_odd_pages(spark):
    urls = [None, "", "://", "http://", "http://a.net/es/" + "x" * 50_000, "http://a.net/es/", "http://a.net/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("mine"), "Verdict": F.lit("mine"), "more": F.lit("stays")})
    rows = url_filter.judged(pages, url_filter.fitted(url_filter.example_labels(pages))).collect()
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in rows[:4]] == [(k, "", None, "allow") for k in range(4)]
    assert [(r.rule, r.verdict, r.more) for r in rows[4:]] == [("net/es/", "block", "stays")] * 3
    assert url_filter.judged(pages.limit(0), url_filter.fitted(url_filter.example_labels(pages.limit(0), n=0))).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    """Sets of no words link nothing, ties go to the smallest id, rows of one id are one node, rows without id stay."""
    mail = "Mail a.b@c.org now or call plus one."
    docs = documents(spark, (1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (None, "a b c d e f"), (None, "a b c d e f"), (5, "x " * 30_000), (9, "x " * 7), (6, "y" * 50_000), (7, mail), (7, mail), (8, " \t\n"))
    docs = docs.withColumns({"kept": F.lit("mine"), "n_shingles": F.lit("mine"), "more": F.lit("stays")})
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == 12
    assert sorted(tuple(r) for r in rows if r.doc_id) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (9, 1, 5, False), (6, 1, 6, True), (7, 3, 7, True), (7, 3, 7, True), (8, 0, 8, True)])
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(2, None, True)] * 2
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 5, 6, 7, 7, 8]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_personal_data_of_odd_rows(spark):
    docs = documents(spark, (1, None), (2, ""), (3, "Mail a.b@c.org now."), (3, "Mail a.b@c.org now."), (None, "+1 (988) 555-2485"), (4, "z" * 60_000)).withColumns({"base_spans": F.lit("mine"), "more": F.lit("stays")})
    found = pii.spotted(docs, pii.fitted(docs)).collect()
    assert sorted((r.doc_id or 0, [tuple(s) for s in r.base_spans], r.more) for r in found) == sorted(
        [(1, [], "stays"), (2, [], "stays"), (4, [], "stays"), (0, [("phone", 0, 17)], "stays")] + [(3, [("email", 5, 14)], "stays")] * 2
    )
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert (clean[1], clean[2], clean[3], clean[None]) == (None, "", "Mail [EMAIL] now.", "[PHONE]")
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.redacted(docs).columns == docs.columns


def test_sentencepiece_of_odd_rows(spark):
    docs = documents(spark, (1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " ")).withColumn("ids", F.lit("mine"))
    rows = sentencepiece_lattice.encode(docs).collect()
    assert len(rows) == 5
    by = {r.doc_id: list(r.ids) for r in rows}
    assert by[1] == by[2] == [] and by[3] and by[None]
    back = {r.doc_id: r.text for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs).select("doc_id", "ids")).collect()}
    assert (back[2], back[3], back[None]) == ("", "a b", " ")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_of_odd_rows(spark, empty):
    """Every stage takes nulls, repeated rows and extra columns, and all but the last give the columns they were given."""
    import corpus_pipeline

    docs = documents(spark, (1, None), (2, ""), (3, PROSE), (3, PROSE), (5, "x " * 20_000), (None, PROSE + " Mail a.b@c.org now.")).withColumns({"kept": F.lit("mine"), "n_hit": F.lit("mine"), "spans": F.lit("mine")})
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == [*docs.columns, "ids"] if name == "sentencepiece" else out.columns == docs.columns
        assert out.count() <= docs.count()
        assert not empty or out.count() == 0
