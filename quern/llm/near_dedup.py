"""Near-duplicates by MinHash in an LSH forest.

Texts whose shingle sets are equal form a class, and one representative of each class goes on.  TREES sorted orders are
laid over the representatives' signatures.  An order's own signature is a sequence of DEPTH minhashes that no other order
has, then 128 one-bit minhashes in a turn of its own; rows are sorted by it, so that a row's neighbours are those with the
longest common prefix.  Two sets of similarity 0.75 begin one order alike with probability 0.75 ** DEPTH, so all TREES miss
such a pair once in about a million.

How deep a prefix makes candidates depends on the region, a run of rows with the first DEPTH minhashes in common:

* in one of up to SMALL rows that prefix is enough: all pairs that pass a bound on sizes and an estimate from the one-bit minhashes;
* a denser one, and one that an edge of a range partition may have cut, is followed along the order's bits, and the nearest
  rows on each side, which share the most of them, are taken;
* after their links are confirmed and components known, such a region is dealt into pieces, and each piece is compared
  with each other piece and itself as one task, all rows with all, but for rows that one component already holds.  Such a
  row's partners stay a list.  Components that lists tie together make a cluster; its listed rows' sets are confirmed in one task, or, if
  they are more than a block, block by block, and one link for each component is enough.  A group of copies thus never
  yields all its pairs, and no size of a region leaves two of its rows uncompared.

Every candidate is confirmed on the full shingle sets.

Defined cases: very long texts are read whole, one at a time; no words or a null text give the empty set, which links with nothing; a text with fewer words than a
shingle is one shingle; rows with equal doc_id are one node; a null doc_id keeps a null component and stays; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens as K
from quern.llm.common import dropped, salted_lookup, trimmed, written
from quern.llm.components import components

SHINGLE, SIMILAR_PERCENT = 5, 75
TREES, DEPTH = 36, 4
HASHES = TREES * DEPTH
SMALL, NEAREST = 24, 2
#: Rows of a region that a task holds at a time while it looks for nearest rows.
HELD = 20_000
#: Rows in a piece of a region.  Above MANY pieces they grow instead, up to LARGE_PIECE.
PIECE, MANY, LARGE_PIECE = 512, 32, 8_192
#: Pairs of rows that a task compares at a time.
CELLS = 250_000
#: Bytes of sets in a block, of which a task holds two; clusters of fewer share bins of about half as many.
BLOCK_BYTES = 32 << 20
#: Bytes of partners' sets that a task compares; a cluster with more is dealt into more blocks.
COMPARED_BYTES = 1 << 30
#: Of 128 one-bit minhashes, those that must agree: sets of similarity 0.75 agree on 112 +- 3.7.
LEAST_AGREEING = 94

_RANDOM = np.random.default_rng(77)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=K.U64) | K.U64(1)
_B = _RANDOM.integers(1, 1 << 63, HASHES, dtype=K.U64)


def _minhashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of HASHES 32-bit minhashes for each set that isn't empty."""
    out = np.empty((HASHES, len(first) - 1), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(((sets * _A[k] + _B[k]) >> K.U64(32)).astype(np.uint32), first[:-1])
    return out.T


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.raw(batch.column(1))
        sizes, marks, keys, sketches = [], [], [], []
        for a, b in K.chunks(offsets):
            sets, first = K.shingle_sets(K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.NOT_SPACE), SHINGLE)
            n = np.diff(first)
            full = np.flatnonzero(n)
            key, sketch, mark = np.zeros((b - a, TREES), K.U64), np.zeros((b - a, 2), K.U64), np.zeros((b - a, 2), K.U64)
            if len(full):
                begin = np.append(first[full], first[-1])
                least = _minhashes(sets, begin)
                for j in range(2):
                    mark[full, j] = np.add.reduceat(K.mixed(sets ^ K._PLACES[40 + j]), begin[:-1])
                lead = least.astype(K.U64).reshape(len(full), TREES, DEPTH)
                key[full] = K.mixed((lead * K._PLACES[:DEPTH]).sum(2, dtype=K.U64) + K._PLACES[5] * np.arange(TREES, dtype=K.U64))
                sketch[full] = np.ascontiguousarray(np.packbits((least[:, :128] & 1).astype(np.uint8), axis=1)).view(">u8").astype(K.U64)
            sizes.append(n)
            marks.append(mark)
            keys.append(key)
            sketches.append(sketch)
        n, mark, key, sketch = (np.concatenate(x) if x else np.zeros((0, 2), K.U64) for x in (sizes, marks, keys, sketches))
        flat = pa.array(key.reshape(-1).view(np.int64))
        tree_keys = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * TREES), flat) if len(key) else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.reshape(-1)[: len(key)].astype(np.int64)), *(pa.array(np.ascontiguousarray(x[:, j]).view(np.int64)) for x in (mark, sketch) for j in range(2)), tree_keys],
            ["doc_id", "n_shingles", "mark1", "mark2", "sketch1", "sketch2", "keys"],
        )


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 128 - (np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1]))


def _passing(sketch: np.ndarray, size: np.ndarray, at: slice, than: slice) -> np.ndarray:
    """Whether rows ``at`` may be similar to rows ``than``, as a matrix."""
    low = np.minimum(size[at, None], size[None, than]) * 100
    fits = low >= SIMILAR_PERCENT * np.maximum(size[at, None], size[None, than])
    return fits & (_agreeing(sketch[at, None], sketch[None, than]) >= LEAST_AGREEING)


def _regions(batches: Iterator[pa.RecordBatch], names: list[str], by: tuple[str, ...] = ("key",), most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Runs of rows that are equal in ``by``, and whether a run is surely whole; the input is sorted.

    Not surely whole are the first and last run of the input, as its neighbours may hold more of them, and the parts of a run of more than ``most`` rows.
    """
    rest: dict[str, np.ndarray] | None = None
    whole = False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        now = {c: np.concatenate([rest[c], now[c]]) for c in names} if rest else now
        cuts = np.flatnonzero(np.logical_or.reduce([np.diff(now[c]) != 0 for c in by])) + 1
        edges = np.concatenate(([0], cuts, [len(now["key"])])).tolist()
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            if b > a:
                yield {c: x[a:b] for c, x in now.items()}, whole
            whole = True
        a = edges[-2]
        while most and len(now["key"]) - a > most:
            yield {c: x[a : a + most] for c, x in now.items()}, False
            a, whole = a + most, False
        rest = {c: x[a:] for c, x in now.items()}
    if rest:
        yield rest, False


def _neighbours(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Candidate pairs, and the rows of regions that are dense or not surely whole (b: null)."""
    a, b, dense = [], [], []
    n = 0

    def out() -> pa.RecordBatch:
        names = ["a", "b", "key", "turn1", "turn2", "n"]
        pairs = [np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)]
        rows = {c: np.concatenate([r[c] for r in dense]) if dense else np.zeros(0, np.int64) for c in ("rep", "key", "turn1", "turn2", "n")}
        p, d = len(pairs[0]), len(rows["rep"])
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [pa.array(np.concatenate([pairs[0], rows["rep"]])), pa.concat_arrays([pa.array(pairs[1], pa.int64()), none(d)])] + [pa.concat_arrays([none(p), pa.array(rows[c], pa.int64())]) for c in names[2:]]
        return pa.RecordBatch.from_arrays(columns, names)

    for region, whole in _regions(batches, ["key", "turn1", "turn2", "rep", "n"], most=held):
        rep, size = region["rep"], region["n"]
        if whole and len(rep) == 1:
            continue
        sketch = np.stack([region["turn1"], region["turn2"]], 1).view(K.U64)
        if len(rep) <= SMALL:
            i, j = np.nonzero(np.triu(_passing(sketch, size, slice(None), slice(None)), 1))
        else:
            i, j = _steps(len(rep))
            keep = (np.minimum(size[i], size[j]) * 100 >= SIMILAR_PERCENT * np.maximum(size[i], size[j])) & (_agreeing(sketch[i], sketch[j]) >= LEAST_AGREEING)
            i, j = i[keep], j[keep]
        if not whole or len(rep) > SMALL:
            dense.append(region)
            n += len(rep)
        if len(i):
            a.append(np.minimum(rep[i], rep[j]))
            b.append(np.maximum(rep[i], rep[j]))
        n += len(i)
        if n > 50_000:
            yield out()
            a, b, dense, n = [], [], [], 0
    yield out()


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of n rows of an order with the NEAREST rows after it."""
    at = np.arange(n)
    return np.concatenate([at[:-k] for k in range(1, NEAREST + 1)]), np.concatenate([at[k:] for k in range(1, NEAREST + 1)])


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of rows after rows i and j are joined; each root is the first of its rows."""
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root, up := root[root]):
            root = up


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two pieces of a region, rows with their larger partners from other components that may be similar.

    Every row of these lists comes out too, with its component and the smallest component that they tie it to (partners: null).
    """
    names = ["a", "partners", "component", "tie"]
    for rows, _ in _regions(batches, ["key", "low", "high", "piece", "turn1", "turn2", "rep", "n", "component"], ("key", "low", "high")):
        at = np.argsort(rows["piece"], kind="stable")
        rep, size, part, piece = (rows[c][at] for c in ("rep", "n", "component", "piece"))
        sketch = np.stack([rows["turn1"][at], rows["turn2"][at]], 1).view(K.U64)
        alone = rows["low"][0] == rows["high"][0]
        upto = len(rep) if alone else int(np.searchsorted(piece, rows["high"][0]))
        others = slice(0 if alone else upto, len(rep))
        if upto == 0 or others.start == len(rep) or (part == part[0]).all():
            continue
        step, (own, code) = max(1, CELLS // (others.stop - others.start)), np.unique(part, return_inverse=True)
        root, listed = np.arange(len(own)), np.zeros(len(rep), bool)
        for first in range(0, upto, step):
            some = slice(first, min(first + step, upto))
            fits = _passing(sketch, size, some, others) & (part[some, None] != part[None, others])
            if alone:
                fits &= rep[some, None] < rep[None, others]
            i, j = np.nonzero(fits)
            if len(i):
                i, j = i + first, j + others.start
                root = _united(root, code[i], code[j])
                listed[i] = listed[j] = True
                a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
                order = np.argsort(a, kind="stable")
                full, begin = np.unique(a[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.ListArray.from_arrays(pa.array(np.append(begin, len(a)).astype(np.int32)), pa.array(b[order])), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64())], names)
        at = np.flatnonzero(listed)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(part[at]), pa.array(own[root[code[at]]])], names)


def _turned(tree: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """128 bits turned by an amount of the tree's own."""
    a, b = F.when(tree % 2 == 0, first).otherwise(second), F.when(tree % 2 == 0, second).otherwise(first)
    by = (tree * 37) % 63 + 1  # 37 and 63 have no common factor
    left = lambda x, y: F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftrightunsigned", y, 64 - by))
    return left(a, b), left(b, a)


def opened(known: DataFrame) -> DataFrame:
    """Rows (key, turn1, turn2, rep, n, component) of the keys with several components, with ``piece`` and the pieces to compare it with.

    A component of PIECE rows or more has pieces of its own, which aren't compared with each other; the others of a key share pieces.
    """
    counts = known.groupBy("key", "component").agg(F.count("*").alias("c"))
    large = F.col("c") >= PIECE
    keys = counts.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("c").alias("c"), F.coalesce(F.sum(F.when(~large, F.col("c"))), F.lit(0)).alias("shared"),
        F.sort_array(F.collect_list(F.when(large, F.struct("component", "c")))).alias("own"),
    ).filter("parts > 1")
    keys = keys.withColumn("rows", F.expr(f"greatest({PIECE}, least({LARGE_PIECE}, ceil(c / {MANY})))")).withColumn("shared", F.expr("ceil(shared / rows)"))
    keys = keys.withColumn("own", F.expr("transform(own, x -> struct(x.component as component, ceil(x.c / rows) as k))"))
    keys = keys.withColumn("own", F.expr("transform(own, (x, i) -> struct(x.component as component, x.k as k, shared + aggregate(slice(own, 1, i), 0L, (a, y) -> a + y.k) as start))"))
    keys = keys.select("key", "c", "shared", "own", F.expr("shared + aggregate(own, 0L, (a, y) -> a + y.k)").alias("pieces"))
    rows = salted_lookup(known, keys, "key", F.col("rep"), "c").filter("pieces is not null").withColumn("mine", F.expr("get(filter(own, x -> x.component = component), 0)"))
    rows = rows.withColumn("piece", F.expr("if(mine is null, pmod(xxhash64(rep), shared), mine.start + pmod(xxhash64(rep), mine.k))"))
    others = F.expr("filter(sequence(0L, pieces - 1), q -> mine is null or q < mine.start or q >= mine.start + mine.k)")
    return rows.select("key", "turn1", "turn2", "rep", "n", "component", "piece", others.alias("others"))


def across(order: DataFrame, parts: int) -> DataFrame:
    """(a, partners, component, tie) from the rows of opened(): each piece held against each of its others."""
    pairs = order.withColumn("other", F.explode("others")).withColumns({"low": F.least("piece", "other"), "high": F.greatest("piece", "other")}).drop("other", "others")
    return pairs.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(trimmed(_across), "a long, partners array<long>, component long, tie long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.raw(batch.column(1))
        out = []
        for a, b in K.chunks(offsets):
            sets, first = K.shingle_sets(K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.NOT_SPACE), SHINGLE)
            out += [sets[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), K.U64), np.frombuffer(y.as_buffer(), K.U64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= SIMILAR_PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose full shingle sets are similar, as a table, and its path; sets are made for documents in pairs only."""
    spark = docs.sparkSession
    pairs, p1 = written(pairs.distinct(), "pairs")
    needed, p2 = written(pairs.select(F.explode(F.array("a", "b")).alias(doc_id)).distinct(), "needed")
    one = docs.select(doc_id, text).join(needed, doc_id, "left_semi")
    sets, p3 = written(one.mapInArrow(trimmed(_sets), "rep long, shingles binary").dropDuplicates(["rep"]), "sets")
    joined = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")
    links, path = written(joined.select("a", "b", "x", "y").mapInArrow(trimmed(_confirmed), "a long, b long"), "confirmed")
    dropped(spark, p1, p2, p3)
    return links, path


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of the rows of one block of sets with their partners in another, one for each component."""
    at = {r: k for k, r in enumerate(right.column("rep").to_pylist())}
    flat, first = K.raw(right.column("shingles"))
    flat, first = np.frombuffer(flat.tobytes(), K.U64), first // 8
    size, part = np.diff(first), right.column("component").to_numpy()
    a, b = [], []
    for rep, own, partners in zip(left.column("a").to_pylist(), left.column("shingles"), left.column("partners"), strict=True):
        here = np.array([at[p] for p in partners.as_py() if p in at], np.int64)
        own = np.frombuffer(own.as_buffer(), K.U64)
        if not len(here) or not len(own):
            continue
        edges = np.concatenate(([0], np.cumsum(size[here])))
        other = flat[np.repeat(first[here] - edges[:-1], size[here]) + np.arange(edges[-1])]
        near = np.minimum(np.searchsorted(own, other), len(own) - 1)
        common = np.add.reduceat((own[near] == other).astype(np.int64), edges[:-1])
        linked = here[100 * common >= SIMILAR_PERCENT * (len(own) + size[here] - common)]
        for k in np.unique(part[linked], return_index=True)[1]:
            a.append(rep)
            b.append(int(right.column("rep")[int(linked[k])].as_py()))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def confirmed_lists(lists: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """Links (a, b) from rows (a, partners), confirmed on the full shingle sets, as a table, and its path.

    ``nodes`` has (rep, component, cluster) of every document named, whose partners are in its cluster.  Clusters of up to
    BLOCK_BYTES of sets and COMPARED_BYTES to compare are dealt into bins, of which each is a task.  The sets of a larger one are
    dealt into blocks, and each two blocks are a task; a row with partners goes only to blocks that hold some of them.  So no pair
    becomes a row, no set of a smaller cluster is copied, and no group is one task whatever its size.
    """
    spark = docs.sparkSession
    lists, p1 = written(lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")), "partners")
    one = docs.select(doc_id, text).join(nodes.select(F.col("rep").alias(doc_id)), doc_id, "left_semi")
    sets, p2 = written(one.mapInArrow(trimmed(_sets), "rep long, shingles binary").dropDuplicates(["rep"]).join(nodes, "rep"), "sets")
    sizes = sets.groupBy("cluster").agg(F.sum(F.octet_length("shingles")).alias("bytes"), F.count("*").alias("rows"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // BLOCK_BYTES))
    work = lists.select(F.col("a").alias("rep"), F.size("partners").alias("n")).join(nodes, "rep").groupBy("cluster").agg(F.sum("n").alias("pairs"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.sqrt(F.coalesce("pairs", F.lit(0)) * F.col("bytes") / F.col("rows") / COMPARED_BYTES)))
    cuts = sizes.join(work, "cluster", "left").select("cluster", blocks.cast("long").alias("cuts"), "rows")

    def dealt() -> DataFrame:
        own = salted_lookup(spark.read.schema(sets.schema).parquet(p2), cuts, "cluster", F.col("rep"), "rows").withColumn("big", F.col("cuts") > 1)
        return own.withColumn("bin", F.when(F.col("big"), F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins)))).withColumn("block", F.expr("pmod(xxhash64(rep), cuts)"))

    right = dealt().select("big", "bin", F.explode(F.expr("sequence(0L, cuts - 1)")).alias("i"), F.col("block").alias("j"), "rep", "shingles", "component")
    of_block = F.expr("filter(transform(sequence(0L, cuts - 1), j -> struct(j as j, if(cuts = 1, partners, filter(partners, p -> pmod(xxhash64(p), cuts) = j)) as partners)), x -> size(x.partners) > 0)")
    left = lists.join(dealt().withColumnRenamed("rep", "a"), "a").select("big", "bin", F.col("block").alias("i"), "a", "shingles", F.explode(of_block).alias("x")).select("big", "bin", "i", "x.j", "a", "shingles", "x.partners")
    task = ["big", "bin", "i", "j"]
    links, path = written(left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_block_links, "a long, b long"), "confirmed")
    dropped(spark, p1, p2)
    return links, path


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), as a table: kept is true for the smallest doc_id of each component."""
    spark = docs.sparkSession
    signed, signed_path = written(docs.select(F.col(doc_id).cast("long"), text).mapInArrow(trimmed(_signatures), "doc_id long, n_shingles long, mark1 long, mark2 long, sketch1 long, sketch2 long, keys array<long>"), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("mark1", "mark2", "n_shingles").agg(F.min_by(F.struct(F.col("doc_id").alias("rep"), "sketch1", "sketch2", "keys"), "doc_id").alias("r"), F.count("*").alias("rows")).select("mark1", "mark2", "n_shingles", "rows", "r.*")
    classes, classes_path = written(classes, "classes")
    flat = classes.select(F.posexplode("keys").alias("tree", "key"), "sketch1", "sketch2", "rep", F.col("n_shingles").alias("n"))
    turn1, turn2 = _turned(F.col("tree"), F.col("sketch1"), F.col("sketch2"))
    rows = flat.select("key", turn1.alias("turn1"), turn2.alias("turn2"), "rep", "n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = rows.repartitionByRange(parts, "key", "turn1").sortWithinPartitions("key", "turn1", "turn2")
    near, near_path = written(order.mapInArrow(trimmed(partial(_neighbours, held=HELD)), "a long, b long, key long, turn1 long, turn2 long, n long"), "near")
    links, links_path = confirmed(near.filter("b is not null").select("a", "b"), docs, doc_id, text)
    gone = [signed_path, classes_path, near_path, links_path]
    dense = near.filter("b is null")
    if not dense.isEmpty():
        first, first_path = components(links, "a", "b")
        known = dense.withColumnRenamed("a", "rep").drop("b").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_rows, open_path = written(opened(known), "open")
        found, found_path = written(across(open_rows, parts), "across")
        gone += [first_path, open_path, found_path]
        if not found.isEmpty():
            clusters, clusters_path = components(found.select("component", "tie"), "component", "tie")
            listed = found.filter("partners is null").select(F.col("a").alias("rep"), "component").distinct()
            nodes = listed.join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component").select("rep", "component", "cluster")
            nodes, nodes_path = written(nodes, "nodes")
            more, more_path = confirmed_lists(found.filter("partners is not null").select("a", "partners"), nodes, docs, doc_id, text)
            links = links.union(more)
            gone += [clusters_path, nodes_path, more_path]
    whole, whole_path = components(links, "a", "b")
    of_class = classes.select("mark1", "mark2", "n_shingles", "rep", "rows").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(F.struct("mark1", "mark2", "n_shingles").alias("k"), F.coalesce("component", "rep").alias("component"), "rows")
    each = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.struct("mark1", "mark2", "n_shingles")).alias("k"))
    out = salted_lookup(each, of_class, "k", F.col("doc_id"), "rows")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out, _ = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    dropped(spark, *gone, whole_path)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group; rows that repeat a kept doc_id stay with it."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    # what goes grows with the corpus: one plan for every size, never a broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")
