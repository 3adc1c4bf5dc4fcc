"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so that equal texts lie together and a large group of them can
still be cut.  Splitters for all shards are sought at once: each round counts the exact bytes below all probes in one pass
with partial sums, and draws new probes from the rows strictly between the nearest ones, until each splitter is within the
tolerance of its target or no key is left between.  The first round's probes, whose bytes are counted too, cut shards into
ranges of about RANGE_BYTES, as many as the table needs.  Then the rows are exchanged once, by range, and numbered: a row's
slot is its place in its range and the rows of the shard's ranges before it.

Defined cases: a null text has no bytes (size 1) and the checksum of an empty one; very long texts are rows like others and
are never cut; rows with equal id and text can be cut apart only as one (they have one key), so a shard may be larger by
them; an empty table gives empty shards; null ids take part like others; other columns stay, clashing names are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import dropped, written

Key = tuple[int, int]
#: Bytes of a range, and the ranges of a table: at least so many for each shard, and at most so many (which bounds what the driver sees; a task sorts a larger range by spilling).
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 16, 32_768
#: Probes drawn in the first round at least and for each range, and for each bracket later.
FIRST_PROBES, RANGE_PROBES, PROBES = 4_096, 4, 16
#: Bytes by which a splitter may miss its target, as a share of a shard.
TOLERANCE = 0.00125


def _bucket(probes: list[Key]):
    """A function of the two halves of a key: twice the number of probes that are not above it, and 1 more if the last of them is the key."""
    high = np.array([p[0] for p in probes], np.int64)
    low = np.array([p[1] for p in probes], np.int64)

    @F.pandas_udf("int")
    def bucket(h: pd.Series, g: pd.Series) -> pd.Series:
        h, g = h.to_numpy(), g.to_numpy()
        at, end = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        same = np.zeros(len(h), bool)
        for k in np.flatnonzero(end - at > 0):  # probes with this very hash: the second half decides
            at[k] += np.searchsorted(low[at[k] : end[k]], g[k], "right")
            same[k] = at[k] > 0 and high[at[k] - 1] == h[k] and low[at[k] - 1] == g[k]
        return pd.Series((2 * at + same).astype(np.int32))

    return bucket


def _counted(keyed: DataFrame, probes: list[Key], draws: int, turn: int) -> list[tuple[int, int, Key | None]]:
    """Bytes by (bucket, draw), with a key drawn from each that is no probe: that of the smallest hash, so that a frequent key is drawn once."""
    rows = keyed.withColumn("v", _bucket(probes)("h", "g") if probes else F.lit(0)).withColumn("p", F.xxhash64("h", "g", F.lit(turn)))
    drawn = F.min_by(F.struct("h", "g"), F.when(F.col("v") % 2 == 0, F.col("p")))
    found = rows.groupBy(F.floor(F.col("v") / 2).alias("b"), F.pmod("p", F.lit(draws)).alias("j")).agg(F.sum("size").alias("size"), drawn.alias("k"))
    return [(r["b"], r["size"], (r["k"]["h"], r["k"]["g"]) if r["k"] else None) for r in found.collect()]


def _nearest(below: list[int], target: int) -> int:
    k = bisect_left(below, target)
    return k if k < len(below) and (k == 0 or below[k] - target < target - below[k - 1]) else k - 1


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> tuple[list[Key], list[Key]]:
    """Keys (h, g) that cut a table of (h, g, size) into shards of nearly equal bytes, and keys that cut it into ranges; a row belongs below the first that is above it."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], []
    ranges = min(MOST_RANGES, max(shards * LEAST_RANGES, -(-total // range_bytes)))
    targets, slack = [total * k // shards for k in range(1, shards)], tolerance * total / shards
    sought = set(targets)
    best: dict[int, tuple[int, Key]] = {}  # for each target its miss and its splitter so far
    probes = sorted({key for _, _, key in _counted(keyed, [], max(FIRST_PROBES, RANGE_PROBES * ranges), 0)})
    finer: set[Key] = set()
    for turn in count(1):
        sums, drawn = [0] * (len(probes) + 1), {}
        for b, size, key in _counted(keyed, probes, PROBES if turn > 1 else 1, turn):
            sums[b] += size
            if key:
                drawn.setdefault(b, set()).add(key)
        below = np.cumsum(sums)[:-1].tolist()  # exact bytes below each probe
        if turn == 1:
            finer = {probes[_nearest(below, total * k // ranges)] for k in range(1, ranges)}
        following: set[Key] = set()
        for t in list(sought):
            k = bisect_left(below, t)
            for j in (k - 1, k):
                if 0 <= j < len(probes) and (t not in best or abs(below[j] - t) < best[t][0]):
                    best[t] = (abs(below[j] - t), probes[j])
            # keys drawn from bucket k lie strictly between probes k - 1 and k: each round narrows a bracket, and one without keys is as narrow as can be
            if best[t][0] > slack and k in drawn:
                following |= drawn[k] | set(probes[max(k - 1, 0) : k + 1])
            else:
                sought.remove(t)
        if not following:
            break
        probes = sorted(following)
    cuts = [best[t][1] for t in targets]
    return cuts, sorted(finer.union(cuts))


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard and slot, the row's place in its shard, without gaps from 0."""
    spark = docs.sparkSession
    own = ("size", "text_crc32", "law", "shard", "slot")
    kept = [c for c in docs.columns if c.lower() not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    keys = {"h": F.xxhash64(body), "g": F.xxhash64(F.col(doc_id), F.crc32(body.cast("binary"))), "size": F.octet_length(body).cast("long") + 1}
    keyed, path = written(docs.select(*(c.alias(n) for n, c in keys.items())), "keys")
    cuts, bounds = splitters(keyed, shards, tolerance, range_bytes)
    cuts = sorted(cuts)
    in_range = lambda h, g: F.floor(_bucket(bounds)(h, g) / 2).cast("int") if bounds else F.lit(0)
    rows = {r["r"]: r["n"] for r in keyed.select(in_range("h", "g").alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()}
    dropped(spark, path)
    places, before = [], 0  # of each range its shard and the rows before it there
    for r in range(len(bounds) + 1):
        shard = bisect_right(cuts, bounds[r - 1]) if r else 0
        before = before if places and places[-1][1] == shard else 0
        places.append((r, shard, before))
        before += rows.get(r, 0)
    ranged = docs.select(*kept, keys["h"].alias("__h"), keys["g"].alias("__g"), keys["size"].alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")).withColumn("__r", in_range("__h", "__g"))
    place = F.row_number().over(Window.partitionBy("__r").orderBy("__h", "__g"))
    table = F.broadcast(spark.createDataFrame(places, "__r int, shard int, __before long"))  # MOST_RANGES rows and a few
    numbered = ranged.withColumn("__place", place).join(table, "__r")
    return numbered.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__place") - 1 + F.col("__before")).cast("long").alias("slot"))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
