"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units at every place that no piece of the vocabulary spans, which leaves the result unchanged.  The
frequent units are encoded in Spark: their substrings of bounded length are exploded, equi-joined to the piece table,
gathered as edges of each unit's lattice, and folded with a higher-order aggregate.  Their encodings (HEAD rows at most)
go to the workers, which encode the other units over the same lattice in NumPy and keep a bounded table of them: there
is no bound on the number of units.  Sending all units through Spark and joining them back to their texts was built and
measured (README): it takes several times the CPU time and the disk that the check tool allows.

The fold is the model's: for a unigram model Viterbi, the path of the highest sum of scores; for a BPE model, whose
scores are ranks of merges, the adjacent edges that form the best edge are merged until none is left.  (The path with
the best sum of ranks isn't what a BPE model encodes.)  Characters outside the vocabulary become byte pieces, or the
unknown piece where the model has none.

Defined cases: a null or empty text has no ids; decoding gives back every text but for U+2581, which the format itself
writes for a space; very long texts are encoded whole, and a long unit in time that grows with its length; rows are encoded one by one, so repeated rows and empty tables need no care; other columns stay and
clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokens as K
from quern.llm.common import trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BAR = "▁"
NORMAL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 2, 6, 1, 2
#: Units that the Spark lattice encodes for the workers, and the occurrences in a chunk from which a unit is proposed.
HEAD, PROPOSED = 65_536, 4
#: Characters worked on at a time; units that a worker remembers; characters from which a unit is folded with a heap.
CHUNK, CACHE, LONG = 1 << 19, 300_000, 48
_NONE = np.int64(1) << 62
_CHAR_CODES = np.random.default_rng(11).integers(1, 1 << 63, 0x110000, dtype=K.U64) | K.U64(1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """Pieces by id with score and kind, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = BPE
    prefix: bool = True

    @staticmethod
    def read(path: str = MODEL) -> Model:
        """From a .model file on the driver; only models that leave texts as they are (identity normaliser) are taken."""
        m, squeeze, rules = Model([], [], []), True, b""
        with open(path, "rb") as file:
            for n, value in _fields(file.read()):
                if n == 1:
                    piece = dict(_fields(value))
                    m.pieces.append(piece.get(1, b"").decode())
                    m.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                    m.kinds.append(piece.get(3, NORMAL))
                elif n == 2:
                    m.kind = dict(_fields(value)).get(3, UNIGRAM)
                elif n == 3:
                    spec = dict(_fields(value))
                    m.prefix, squeeze, rules = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if squeeze or rules or m.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and BPE models with an identity normaliser that keeps spaces are supported")
        return m

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """What a worker needs of a model, as arrays."""

    def __init__(self, model: Model):
        own = [i for i, k in enumerate(model.kinds) if k == NORMAL and model.pieces[i]]
        self.kind, self.prefix = model.kind, model.prefix
        self.rank = {s: r for r, s in enumerate(sorted({model.scores[i] for i in own}, reverse=True))}
        self.of = {model.pieces[i]: (self.rank[model.scores[i]], i, model.scores[i]) for i in own}
        self.longest = max(map(len, self.of), default=1)
        marks = np.array([self._mark(p) for p in self.of], K.U64)
        order = np.argsort(marks)
        self.marks, self.ids = marks[order], np.array([i for _, i, _ in self.of.values()], np.int64)[order]
        self.ranks = np.array([r for r, _, _ in self.of.values()], np.int64)[order]
        self.bytes = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.worst = min(model.scores[i] for i in own) - 10 if own else -10.0
        pairs = {(a, b) for p in self.of for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for ab in pairs for c in ab})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: k + 1 for k, c in enumerate(chars)}
        self.joins = np.zeros((len(chars) + 1) ** 2, bool)
        self.joins[[at[a] * (len(chars) + 1) + at[b] for a, b in pairs]] = True
        self.width = len(chars) + 1
        text = [p.replace(BAR, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_first = np.concatenate(([0], np.cumsum([len(x) for x in text]))).astype(np.int64)

    @staticmethod
    def _mark(piece: str) -> int:
        codes = _CHAR_CODES[[ord(c) for c in piece]]
        return int(K.Sums(codes).spans(np.array([0]), np.array([len(piece)]))[0])

    # -- units

    def prepared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of texts, spaces written as bars, and each text's offset."""
        texts = [(BAR if self.prefix else "") + x.replace(" ", BAR) if x else "" for x in texts]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return chars, np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)

    def units(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.index[chars].astype(np.int64)
        cut = np.ones(len(chars) + 1, bool)
        cut[1:-1] = ~self.joins[at[:-1] * self.width + at[1:]] if len(chars) else True
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    # -- folds

    def spelled(self, char: int) -> list[int]:
        """A character outside the vocabulary."""
        raw = chr(char).encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def fold(self, chars: np.ndarray, sums: K.Sums, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, flat, and where each unit's begin."""
        size = ends - starts
        if self.kind == UNIGRAM:
            hard = np.ones(len(starts), bool)
        else:
            hard = size >= LONG
        counts, flat = np.zeros(len(starts), np.int64), {}
        easy = np.flatnonzero(~hard)
        unit, ids = self._merged(chars, sums, starts[easy], ends[easy])
        unit = easy[unit]
        for k in np.flatnonzero(ids < 0):
            flat[k] = self.spelled(-1 - int(ids[k]))
        widths = np.ones(len(ids), np.int64)
        for k, x in flat.items():
            widths[k] = len(x)
        counts += np.bincount(unit, widths, len(starts)).astype(np.int64)
        slow = {}
        for k in np.flatnonzero(hard):
            text = "".join(map(chr, chars[starts[k] : ends[k]]))
            slow[k] = self.viterbi(text) if self.kind == UNIGRAM else self.heap(text)
            counts[k] = len(slow[k])
        first = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(first[-1], np.int32)
        if len(ids):
            begins = np.concatenate(([0], np.cumsum(widths)[:-1]))
            new = np.concatenate(([True], unit[1:] != unit[:-1]))
            base = np.repeat(begins[new], np.diff(np.append(np.flatnonzero(new), len(unit))))
            at = first[unit] + begins - base
            out[at[widths == 1]] = ids[widths == 1]
            for k, x in flat.items():
                out[at[k] : at[k] + len(x)] = x
        for k, x in slow.items():
            out[first[k] : first[k + 1]] = x
        return out, first

    def _merged(self, chars: np.ndarray, sums: K.Sums, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many short units at once: (unit, id) for each symbol; a character outside the vocabulary is -1 - it."""
        size = ends - starts
        base = np.concatenate(([0], np.cumsum(size)))
        total = int(base[-1])
        unit = np.repeat(np.arange(len(starts)), size)
        place = np.arange(total) - base[unit]
        text = starts[unit] + place
        left = size[unit] - place
        edge_rank = np.full((total, self.longest + 1), _NONE, np.int64)
        edge_id = np.full((total, self.longest + 1), -1, np.int32)
        for length in range(1, self.longest + 1):
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            marks = sums.spans(text[at], text[at] + length)
            near = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
            hit = self.marks[near] == marks
            edge_rank[at[hit], length] = self.ranks[near[hit]]
            edge_id[at[hit], length] = self.ids[near[hit]]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin, owner, end = np.arange(total), unit, np.arange(total) + 1
        while len(begin):
            pair = owner[1:] == owner[:-1]
            length = end[1:] - begin[:-1]
            cost = np.full(len(begin), _NONE, np.int64)
            ok = np.flatnonzero(pair & (length <= self.longest))
            cost[ok] = edge_rank[begin[ok], length[ok]]
            key = np.where(cost < _NONE, (cost << 32) + np.arange(len(begin)), _NONE)
            group = np.flatnonzero(np.concatenate(([True], ~pair)))
            best = np.minimum.reduceat(key, group)
            live = best < _NONE
            stays = np.repeat(live, np.diff(np.append(group, len(begin))))
            if not live.all():
                done.append((owner[~stays], begin[~stays], end[~stays]))
            chosen = (best[live] & 0xFFFFFFFF).astype(np.int64)
            end[chosen] = end[chosen + 1]
            stays[chosen + 1] = False
            begin, owner, end = begin[stays], owner[stays], end[stays]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, begin, end = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((begin, owner))
        owner, begin, end = owner[order], begin[order], end[order]
        ids = edge_id[begin, end - begin].astype(np.int64)
        return owner, np.where(ids >= 0, ids, -1 - chars[text[begin]].astype(np.int64))

    def heap(self, text: str) -> list[int]:
        """BPE of one long unit."""
        n = len(text)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and end[b] - a <= self.longest and (found := self.of.get(text[a : end[b]])):
                heapq.heappush(queue, (found[0], a, end[b]))

        for a in range(n):
            offer(a)
        while queue:
            _, a, to = heapq.heappop(queue)
            if not alive[a] or end[a] >= n or end[a] == to or end[end[a]] != to:
                continue
            alive[end[a]] = False
            end[a] = to
            if to < n:
                before[to] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        a = 0
        while a < n:
            found = self.of.get(text[a : end[a]])
            out += [found[1]] if found else self.spelled(ord(text[a]))
            a = end[a]
        return out

    def viterbi(self, text: str) -> list[int]:
        """The path of the best sum of scores; of equal ones, that whose last piece is longest."""
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
        for e in range(1, len(text) + 1):
            options = [(best[s][0] + found[2], s, [found[1]]) for s in range(max(0, e - self.longest), e) if (found := self.of.get(text[s:e]))]
            if text[e - 1] not in self.of:
                options.append((best[e - 1][0] + self.worst, e - 1, self.spelled(ord(text[e - 1]))))
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        out: list[list[int]] = []
        e = len(text)
        while e:
            out.append(best[e][2])
            e = best[e][1]
        return [i for x in reversed(out) for i in x]


class Known:
    """Encodings of units by fingerprint: those given, and up to CACHE that were met since."""

    def __init__(self, marks: np.ndarray, ids: np.ndarray, first: np.ndarray):
        order = np.argsort(marks)
        self.given = self.now = (marks[order], *_picked(ids, first, order))

    def ids(self, t: Tables, chars: np.ndarray, sums: K.Sums, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, flat, and the number of each unit's."""
        marks, at, back = np.unique(sums.spans(starts, ends), return_index=True, return_inverse=True)
        for again in (False, True):
            known = self.now[0]
            near = np.minimum(np.searchsorted(known, marks), max(len(known) - 1, 0))
            new = np.flatnonzero(known[near] != marks) if len(known) else np.arange(len(marks))
            if not len(new) or again:
                break
            ids, first = t.fold(chars, sums, starts[at[new]], ends[at[new]])
            base = self.now if len(known) + len(new) <= CACHE + len(self.given[0]) else self.given
            if base is self.given and len(self.given[0]) < len(known):  # what was met before goes, but for what is needed now
                need = np.setdiff1d(near[known[near] == marks], [])
                base = (known[need], *_picked(self.now[1], self.now[2], need))
                extra = np.flatnonzero(~np.isin(self.given[0], base[0]))
                base = _together(base, (self.given[0][extra], *_picked(self.given[1], self.given[2], extra)))
            self.now = _together(base, (marks[new], ids, first))
        which = near[back]
        _, ids, first = self.now
        return _picked(ids, first, which)


def _picked(ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[which]
    to = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return ids[np.repeat(first[:-1][which] - to[:-1], size) + np.arange(to[-1])], to


def _together(a: tuple, b: tuple) -> tuple:
    marks = np.concatenate([a[0], b[0]])
    order = np.argsort(marks)
    return (marks[order], *_picked(np.concatenate([a[1], b[1]]), np.concatenate([a[2], a[2][-1] + b[2][1:]]), order))


# -- the lattice of frequent units, in Spark


def lattice(spark: SparkSession, units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of a table of distinct units: explode substrings, join pieces, gather edges, fold.

    The piece table is broadcast: its size is the model's vocabulary, whatever the corpus.
    """
    t = model.tables()
    # a number of its own, which adaptive execution leaves as it is: the fold is dear, its input small
    units = units.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "unit")
    pieces = spark.createDataFrame([(p, r, i, float(s)) for p, (r, i, s) in t.of.items()], "piece string, rank int, id int, score double")
    spans = units.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s")).select("unit", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.length("unit"), F.col("s") + t.longest))).alias("e"))
    edges = spans.withColumn("piece", F.expr("substring(unit, s + 1, e - s)")).join(F.broadcast(pieces), "piece")
    gathered = edges.groupBy("unit").agg(F.collect_list(F.struct("rank", "s", "e", "id", "score")).alias("edges"))
    all_units = units.join(gathered, "unit", "left").withColumn("edges", F.expr("coalesce(edges, cast(array() as array<struct<rank:int,s:int,e:int,id:int,score:double>>))"))
    if t.kind == BPE:
        # the state is the list of boundaries; an edge is open if it covers exactly two symbols
        is_open = "array_contains(b, x.s) and array_contains(b, x.e) and size(filter(b, y -> y > x.s and y < x.e)) = 1"
        step = f"element_at(transform(array(array_min(transform(filter(edges, x -> {is_open}), x -> struct(x.rank, x.s, x.e)))), m -> if(m is null, b, filter(b, y -> y <= m.s or y >= m.e))), 1)"
        folded = all_units.withColumn("b", F.expr(f"aggregate(sequence(1, length(unit)), sequence(0, length(unit)), (b, k) -> {step})"))
    else:
        # the state is the best (score, -start) of each place so far
        reach = f"concat(transform(filter(edges, x -> x.e = k), x -> struct(element_at(a, x.s + 1).score + x.score as score, -x.s as back)), if(exists(edges, x -> x.e = k and x.s = k - 1), cast(array() as array<struct<score:double,back:int>>), array(struct(element_at(a, k).score + {t.worst}D as score, 1 - k as back))))"
        folded = all_units.withColumn("a", F.expr(f"aggregate(sequence(1, length(unit)), array(struct(0D as score, 1 as back)), (a, k) -> concat(a, array(array_max({reach}))))"))
        folded = folded.withColumn("b", F.expr("sort_array(aggregate(sequence(1, length(unit)), array(length(unit)), (b, k) -> if(element_at(b, -1) = 0, b, concat(b, array(-element_at(a, element_at(b, -1) + 1).back)))))"))
    spelled = F.expr("transform(filter(sequence(0, length(unit) - 1), k -> array_contains(b, k)), k -> struct(k as s, element_at(filter(b, y -> y > k), 1) as e))")
    parts = folded.withColumn("spans", spelled)
    bytes_of = {b: i for b, i in t.bytes.items()}
    unknown = "array(" + str(t.unknown) + ")"
    if bytes_of:
        table = "map(" + ", ".join(f"'{b:02X}', {i}" for b, i in sorted(bytes_of.items())) + ")"
        code = "hex(encode(substring(unit, x.s + 1, 1), 'UTF-8'))"
        unknown = f"transform(sequence(0, cast(length({code}) / 2 as int) - 1), h -> element_at({table}, substring({code}, 2 * h + 1, 2)))"
    own = "filter(edges, y -> y.s = x.s and y.e = x.e)"
    ids = f"flatten(transform(spans, x -> if(size({own}) > 0, transform({own}, y -> y.id), {unknown})))"
    return parts.select("unit", F.expr(ids).alias("ids"))


def frequent_units(docs: DataFrame, model: Model, text: str = "text", most: int = HEAD) -> DataFrame:
    """Up to ``most`` units by how often they occur (counted where they recur within a chunk)."""
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            for texts in _runs(batch.column(0)):
                chars, offsets = t.prepared(texts)
                starts, ends = t.units(chars, offsets)
                fits = ends - starts < LONG
                starts, ends = starts[fits], ends[fits]
                _, at, n = np.unique(K.Sums(_CHAR_CODES[chars]).spans(starts, ends), return_index=True, return_counts=True)
                at, n = at[n >= PROPOSED], n[n >= PROPOSED]
                text_of = chars.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([text_of[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[at], ends[at], strict=True)], pa.string()), pa.array(n, pa.int64())], ["unit", "n"])

    counts = docs.select(text).mapInArrow(trimmed(count), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "unit").limit(most).select("unit")


def _runs(column: pa.Array) -> Iterator[list[str]]:
    texts, size = [], 0
    for x in column:
        x = x.as_py() or ""
        texts.append(x)
        size += len(x)
        if size >= CHUNK:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


# -- whole texts


class Encoder:
    """Encodes batches on a worker; made on the driver with the encodings of the frequent units."""

    def __init__(self, docs: DataFrame, model: Model, text: str = "text", head: int = HEAD):
        spark = docs.sparkSession
        t = model.tables()
        rows = lattice(spark, frequent_units(docs, model, text, head), model).toArrow() if head else None
        units = rows.column("unit").to_pylist() if head else []
        chars, offsets = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(u) for u in units]))).astype(np.int64)
        marks = K.Sums(_CHAR_CODES[chars]).spans(offsets[:-1], offsets[1:])
        lists = rows.column("ids").combine_chunks() if head else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ids, first = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.shared = spark.sparkContext.broadcast((t, marks, ids, first))
        self.known: Known | None = None  # made on the worker, for its task

    def encoded(self, column: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """For runs of texts: the texts, their ids, flat, and where each text's begin."""
        t, marks, ids, first = self.shared.value
        if self.known is None:
            self.known = Known(marks, ids, first)
        known = self.known
        for texts in _runs(column):
            chars, offsets = t.prepared(texts)
            starts, ends = t.units(chars, offsets)
            flat, to = known.ids(t, chars, K.Sums(_CHAR_CODES[chars]), starts, ends)
            yield texts, flat, to[np.searchsorted(starts, offsets)]

    def decoded(self, flat: np.ndarray, first: np.ndarray) -> list[bytes]:
        t = self.shared.value[0]
        raw, to = _picked(t.text, t.text_first, flat)
        edges, raw = to[first], raw.tobytes()
        skip = 1 if t.prefix else 0
        return [raw[a + skip if raw[a : a + 1] == b" " else a : b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model: Model | None = None, text: str = "text", head: int = HEAD, ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    encoder, kept = Encoder(docs, model or Model.read(), text, head), [c for c in docs.columns if c.lower() != ids.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32())) for _, flat, first in encoder.encoded(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))], [*batch.schema.names, ids])
        encoder.known = None

    return docs.select(*kept).mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: Model | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of each list of ids (null: none)."""
    encoder, kept = Encoder(rows, model or Model.read(), head=0), [c for c in rows.columns if c.lower() != text.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            first = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in lists]))).astype(np.int64)
            texts = encoder.decoded(lists.flatten().to_numpy(zero_copy_only=False), first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], [*batch.schema.names, text])

    return rows.select(*kept).mapInArrow(trimmed(run), T.StructType([rows.schema[c] for c in kept] + [T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, model: Model | None = None, text: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip): the hex digest of the ids as little-endian 32-bit integers, and whether decoding them gave the text."""
    encoder = Encoder(docs, model or Model.read(), text, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, same = [], [], []
            for texts, flat, first in encoder.encoded(batch.column(1)):
                raw = flat.astype("<i4")
                n += np.diff(first).tolist()
                digest += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                same += [x.encode() == y for x, y in zip(texts, encoder.decoded(flat, first), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])
        encoder.known = None

    return docs.select("doc_id", text).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
