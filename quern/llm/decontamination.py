"""Benchmark decontamination: a broadcast set of normalised n-grams, held against every window of training words.

The n-grams of the benchmark go to the workers as sorted 64-bit fingerprints; a window whose fingerprint is there is
verified word by word before it counts.  Documents that hold enough items are removed, from the others the hit spans.

The set is bounded: the benchmark's windows are a table of fingerprints, words and items, made once and dealt by hash into
blocks of about MAX_WINDOWS rows.  A benchmark of one block, the usual case, is held against the documents in one pass.  Of
a larger one each block is fetched, sent and held against all documents on its own, and leaves the hits of the few texts
that have some; then the hits of all blocks are united and looked up by the texts' hashes.  Neither the driver nor a worker
ever holds more than one block.

Defined cases: a null text has no words; an item or a document without words never hits; very long texts are read whole, one
at a time; repeated items and documents each count by their own id (an item_id that occurs twice counts once); null ids stay
null and never name an item; an empty benchmark leaves every document clean; other columns of the documents stay, clashing
names are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokens as K
from quern.llm.common import dropped, salted_lookup, trimmed, written

#: Words of a window; items that must occur for a document to count as contaminated.
WINDOW, CONTAMINATED_ITEMS = 8, 2
#: Rows (window and item) of a block: each is a fingerprint, eight words and an item, about 100 bytes.
MAX_WINDOWS = 500_000
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item, size, mark, words) of all windows of (item, text)."""
    for batch in batches:
        data, offsets = K.raw(batch.column(1))
        for a, b in K.chunks(offsets):
            w = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.ALPHANUMERIC)
            hashes, first = K.windows(w, window)
            item, size, marks, words = [], [], [], []
            for i, n in enumerate(np.diff(w.first).tolist()):
                if not n:
                    continue
                own = [w.data[x:y].tobytes() for x, y in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
                mark = hashes[first[i] : first[i + 1]] if n >= window else K.whole(w, i)
                marks.append(mark)
                item += [a + i] * len(mark)
                size += [min(window, n)] * len(mark)
                words += [b" ".join(own[k : k + window]) for k in range(len(mark))]
            mark = np.concatenate(marks) if marks else np.zeros(0, K.U64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(size, pa.int32()), pa.array(mark.view(np.int64)), pa.array(words, pa.binary())], ["item", "size", "mark", "words"])


@dataclass
class Grams:
    """Windows of one length, sorted by fingerprint: their words, joined by spaces, and the item that each comes from."""

    marks: np.ndarray
    words: pa.Array
    items: pa.Array


def _packed(rows: pa.Table) -> dict[int, Grams]:
    out = {}
    size, mark = rows.column("size").to_numpy(), rows.column("mark").to_numpy().view(K.U64)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        own = own[np.argsort(mark[own], kind="stable")]
        out[n] = Grams(mark[own], rows.column("words").take(pa.array(own)).combine_chunks(), rows.column("item").take(pa.array(own)).combine_chunks())
    return out


def _scan(data: np.ndarray, offsets: np.ndarray, grams: dict[int, Grams], hit_words: list, items: list, at: int) -> K.Words:
    """Adds to ``hit_words`` and ``items`` of the texts from ``at`` on."""
    w = K.words(data, offsets, K.ALPHANUMERIC)
    for size, own in grams.items():
        hashes, first = K.windows(w, size)
        if not len(hashes):
            continue
        near = np.minimum(np.searchsorted(own.marks, hashes), len(own.marks) - 1)
        hits = np.flatnonzero(own.marks[near] == hashes)
        if not len(hits):
            continue
        text = np.searchsorted(first, hits, "right") - 1
        word = hits - first[text] + w.first[text]
        for i, k, g, mark in zip(text.tolist(), word.tolist(), near[hits].tolist(), hashes[hits], strict=True):
            words, found = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[k : k + size], w.ends[k : k + size], strict=True)), False
            while g < len(own.marks) and own.marks[g] == mark:
                if own.words[g].as_py() == words:
                    found = True
                    if (item := own.items[g].as_py()) is not None:
                        items[at + i].add(item)
                g += 1
            if found:
                hit_words[at + i].append((k - int(w.first[i]), k - int(w.first[i]) + size))
    return w


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, clean: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (those found, sorted as strings), hits (spans of words) and, if ``clean``, clean_text (without them)."""
    own = ["n_words", "n_hit", "item_ids", "hits", "clean_text"]
    spark, kept = docs.sparkSession, [c for c in docs.columns if c.lower() not in own]
    found = benchmark.select(F.col(item).cast("string").alias("item"), item_text).mapInArrow(trimmed(partial(_cut, window=window)), "item string, size int, mark long, words binary")
    windows, path = written(found.distinct(), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    fetched = lambda k: spark.sparkContext.broadcast(_packed(windows.filter(F.pmod(F.xxhash64("mark", "item"), F.lit(blocks)) == k).toArrow()))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hits", HITS)]
    schema = T.StructType([docs.schema[c] for c in kept] + fields + [T.StructField("clean_text", T.StringType())] * clean)
    if blocks == 1:
        only = fetched(0)
        dropped(spark, path)
        return docs.select(*kept).mapInArrow(trimmed(_pass(only, text, True, clean)), schema)
    # two hashes of a text tell it from all others
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    one, parts = docs.select(key.alias("k"), text), []
    for k in range(blocks):
        grams = fetched(k)
        hit = one.mapInArrow(trimmed(_pass(grams, text, True, False)), T.StructType([*one.schema, *fields])).filter(F.size("hits") > 0)
        part, _ = written(hit.groupBy("k").agg(F.first("hits").alias("hits"), F.first("item_ids").alias("item_ids"), F.count("*").alias("n")), "hits")
        parts.append(part)
        grams.destroy()
    dropped(spark, path)
    united = parts[0]
    for part in parts[1:]:
        united = united.union(part)
    united = united.groupBy("k").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("n").alias("n"))
    rows = salted_lookup(docs.select(*kept, key.alias("k")), united, "k", F.monotonically_increasing_id(), "n")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    ready = rows.select(*kept, none("item_ids", T.ArrayType(T.StringType())), none("hits", HITS))
    return ready.mapInArrow(trimmed(_pass(None, text, False, clean)), schema)


def _pass(sent: Broadcast | None, text: str, start: bool, clean: bool):
    """Holds texts against a block (None: none), from no hits (``start``) or from those that the rows have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = sent.value if sent else {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = K.raw(column)
            n = len(offsets) - 1
            hit_words: list = [[] for _ in range(n)] if start else [[(s["start"], s["end"]) for s in x] for x in batch.column("hits").to_pylist()]
            items: list = [set() for _ in range(n)] if start else [set(x) for x in batch.column("item_ids").to_pylist()]
            counts, cleaned = [], []
            for a, b in K.chunks(offsets):
                w = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], grams, hit_words, items, a)
                counts.append(np.diff(w.first))
                if clean:
                    cleaned += [None if column[i].as_py() is None else _without(data[offsets[i] : offsets[i + 1]], w, i - a, _joined(hit_words[i])) for i in range(a, b) if hit_words[i]]
            hits = [_joined(x) for x in hit_words]
            arrays = [batch.column(c) for c in batch.schema.names if c not in ("n_words", "n_hit", "item_ids", "hits")]
            names = [c for c in batch.schema.names if c not in ("n_words", "n_hit", "item_ids", "hits")]
            arrays += [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array([sum(b - a for a, b in x) for x in hits], pa.int64()), pa.array([sorted(map(str, x)) for x in items], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in x] for x in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            if clean:
                at = iter(cleaned)
                dirty = {i: next(at) for i in range(n) if hit_words[i]}
                arrays.append(column.cast(pa.string()) if not dirty else pa.array([dirty[i] if i in dirty else column[i].as_py() for i in range(n)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "n_hit", "item_ids", "hits", *["clean_text"] * clean])

    return scan


def _without(data: np.ndarray, w: K.Words, text: int, spans: list[tuple[int, int]]) -> str:
    """A text (its own bytes, in their own case) without spans of words and the space before each."""
    first, base, at, parts = int(w.first[text]), int(w.texts[text]), 0, []
    for a, b in spans:
        parts.append(data[at : int(w.starts[first + a]) - base].tobytes().rstrip(b" "))
        at = int(w.ends[first + b - 1]) - base
    return b"".join([*parts, data[at:].tobytes()]).decode()


def digest(marks: DataFrame) -> DataFrame:
    return marks.withColumns({"n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ",").cast("binary"), 256), "contaminated": F.size("item_ids") >= CONTAMINATED_ITEMS})


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Without the contaminated documents, and without the hit spans of the others."""
    out = marked(docs, benchmark).filter(F.size("item_ids") < CONTAMINATED_ITEMS)
    return out.withColumn("text", F.col("clean_text")).select(*docs.columns)
