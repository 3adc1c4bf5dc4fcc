"""Personal data by weak supervision.

Candidate spans come from fixed patterns (the base) and from looser ones.  Five labelers vote on each candidate - its
pattern, a gazetteer, the words before it, its characters and its borders - and the counts of all vote patterns in the
corpus, a table whose size doesn't depend on the corpus, go to the driver.  There expectation-maximisation estimates how
reliable each labeler is for each kind, and a logistic span classifier is trained on the posteriors.  Base spans always
stay; the classifier adds candidates beside them.

Defined cases: a null text counts as an empty one, which has no spans; repeated rows have equal spans; a table without
candidates adds none; other columns stay and clashing names are replaced.  Very long texts are read whole, in time that
grows with their length: no pattern tries a run of its characters from more than one place, and marks of spelled addresses
(``at``, ``dot``) are found first and extended outwards.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import trimmed

#: Kinds in the order of reports; the first four have a base.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: Fixed values of the base.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only begin where a run of digits does: what fails there fails at every later digit of the run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser patterns.  A spelled address has its marks in brackets or between spaces.
_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?| (?:at|AT) ")
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?| (?:dot|DOT) )[A-Za-z0-9-]++)++")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?![A-Za-z0-9_+/-])")
_ANY = re.compile(r"[0-9@]")
#: The longest local part that an address may have; a longer run before a spelled sign is none.
MAX_LOCAL = 64
#: Gazetteers.
_TLDS = frozenset("com org net edu gov int io co de fr es it uk us eu info biz app dev me".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
_KEY_HEADS = ("AKIA", "ASIA", "sk-", "pk_", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
_FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|call|tel|phone|mobile|fax|card|visa|credit|account|ssn|social security|passw(?:or)?d|pwd|token|secret|api[_ -]?key|access[_ -]?key|key|login|host|ip|address)\b[\s:=\"'>]*$")
_AGAINST = re.compile(r"(?i)\b(?:version|section|chapter|figure|fig|page|isbn|issn|doi|commit|sha-?\d*|md5|uuid|checksum|digest|table|line|id)\b[\s:=.#\"'>]*$")
LABELERS = ("pattern", "gazetteer", "context", "characters", "borders")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k & 1:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap; those that fail the kind's check are dropped."""
    out = []
    if "@" in text:
        end, at = 0, text.find("@")
        while at >= 0:
            head = text[max(end, text.rfind("@", 0, at) + 1) : at]
            size = len(head) - len(head.rstrip(_LOCAL))
            if size and (found := _DOMAIN.match(text, at + 1)):
                end = found.end()
                out.append(("email", at - size, end))
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _spelled(text: str) -> list[tuple[str, int, int]]:
    """Addresses whose signs are spelled: each mark, the run before it that may be a local part, and the host after it."""
    out, end, at = [], 0, 0
    while m := _AT.search(text, at):
        at = m.end() - 1 if m.group().endswith(" ") else m.end()  # a space may lead the next mark too
        head = text[max(end, m.start() - MAX_LOCAL - 1) : m.start()]
        size = len(head) - len(head.rstrip(_LOCAL))
        if 0 < size <= MAX_LOCAL and (found := _SPELLED_HOST.match(text, m.end())):
            end = at = found.end()
            out.append(("email", m.start() - size, end))
    return out


def _apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of those taken."""
    ends, starts, reach = [], [], 0
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if starts and a < reach:
            reach = ends[-1] = max(reach, b)
        else:
            starts.append(a)
            ends.append(b)
            reach = b
    free = lambda a, b: (k := bisect.bisect_right(ends, a)) == len(starts) or starts[k] >= b
    return [s for s in spans if free(s[1], s[2])]


def _entropy(text: str) -> float:
    counts = np.array([text.count(c) for c in set(text)], float) / len(text)
    return float(-(counts * np.log2(counts)).sum())


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for personal data, -1 against, 0 for none."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = _digits(span)
    if kind == "email":
        pattern, gazetteer = 1 if base else 0, 1 if span.lower().split(".")[-1].split(" ")[-1] in _TLDS else -1
        characters = 1 if len(span) <= 64 else -1
    elif kind == "ip":
        pattern, gazetteer = 1, -1 if span.split(".")[0] in ("0", "127", "255") else 1
        characters = 1 if any(len(x) > 1 for x in span.split(".")) else -1
    elif kind == "card":
        pattern, gazetteer = (1 if base else 0), 1 if digits[0] in "3456" else -1
        characters = -1 if len(set(digits)) < 4 else 1
    elif kind == "phone":
        pattern = 1 if base else 0
        gazetteer = 1 if not base or digits.startswith(_DIAL) else -1
        characters = -1 if len(set(digits)) < 3 else 1
    elif kind == "secret":
        pattern = 1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Z]{4}[0-9A-Z]{16}", span) else 0
        gazetteer = 1 if span.startswith(_KEY_HEADS) or re.search(r"(?i)(?:passw(?:or)?d|pwd|token|secret|key)[\s:=\"']*$", before) else 0
        characters = 1 if digits and re.search("[A-Za-z]", span) and _entropy(span) >= 3 else -1
    else:
        pattern, gazetteer = 1, -1 if span[:3] in ("000", "666") or span[0] == "9" else 1
        characters = 1 if len(set(digits)) > 3 else -1
    context = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    borders = -1 if left.isalnum() or right.isalnum() or left in ("/", "\\") and left else 1
    return pattern, gazetteer, context, characters, borders


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    size: int

    @property
    def pattern(self) -> str:
        return ",".join([self.kind, *map(str, self.votes), str(self.size), str(int(self.base))])


def candidates(text: str | None) -> list[Candidate]:
    if not text:
        return []
    some = _ANY.search(text) is not None
    spelled = "dot" in text or "DOT" in text
    if not some and not spelled:
        return []
    base = base_spans(text) if some else []
    more = _spelled(text) if spelled else []
    if some:
        more += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        more += [("secret", *m.span()) for m in _SECRET.finditer(text) if re.search("[0-9]", m.group())]
    found = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in _apart(more, base)]
    return [Candidate(k, a, b, own, _votes(text, k, a, b, own), min(int(np.log2(b - a)), 7)) for k, a, b, own in found]


# -- what the votes say


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): how many candidates of the corpus have each pattern of kind, votes and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                for c in candidates(value.as_py()):
                    counts[c.pattern] = counts.get(c.pattern, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return docs.select(text).mapInArrow(trimmed(run), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


class SpanModel:
    """Labelers' reliabilities by expectation-maximisation, and a logistic classifier of spans."""

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        rows = [p.split(",") for p in sorted(counts)]
        n = np.array([counts[p] for p in sorted(counts)], float)
        kinds = np.array([KINDS.index(r[0]) for r in rows], int)
        votes = np.array([[int(x) for x in r[1 : 1 + len(LABELERS)]] for r in rows], int).reshape(len(rows), len(LABELERS))
        self.reliability = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
        self.posterior: dict[str, float] = {}
        p = 1 / (1 + np.exp(-votes.sum(1).astype(float))) if len(rows) else np.zeros(0)
        for k in range(len(KINDS)):
            own = np.flatnonzero(kinds == k)
            if not len(own):
                continue
            q = p[own].copy()
            for _ in range(rounds):
                prior = (n[own] @ q + 1) / (n[own].sum() + 2)
                for j in range(len(LABELERS)):
                    for c, weight in ((1, n[own] * q), (0, n[own] * (1 - q))):
                        # a labeler is taken to be right rather than wrong until votes say otherwise
                        hoped = np.array([1.0, 2.0, 4.0]) if c else np.array([4.0, 2.0, 1.0])
                        seen = np.bincount(votes[own, j] + 1, weight, 3) + hoped
                        self.reliability[k, j, c] = seen / seen.sum()
                odds = np.log(prior / (1 - prior)) + sum(np.log(self.reliability[k, j, 1, votes[own, j] + 1] / self.reliability[k, j, 0, votes[own, j] + 1]) for j in range(len(LABELERS)))
                q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            p[own] = q
        self.posterior = {q: float(x) for q, x in zip(sorted(counts), p, strict=True)}
        self.weights = np.zeros(self._row("email,0,0,0,0,0,4,0").shape)
        if not len(rows):
            return
        x = np.stack([self._row(q) for q in sorted(counts)])
        w = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(400):  # gradient steps on the cross-entropy with the posteriors
            fit = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            self.weights += 4.0 * (x.T @ (w * (p - fit)) - 1e-4 * self.weights)

    @staticmethod
    def _row(pattern: str) -> np.ndarray:
        kind, *rest = pattern.split(",")
        votes, size = [int(v) for v in rest[: len(LABELERS)]], int(rest[len(LABELERS)])
        k = KINDS.index(kind)
        one = np.zeros(1 + len(KINDS) + len(KINDS) * len(LABELERS) + 8)
        one[0] = one[1 + k] = 1
        one[1 + len(KINDS) + k * len(LABELERS) : 1 + len(KINDS) + (k + 1) * len(LABELERS)] = votes
        one[-8 + size] = 0.5
        return one

    def likely(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self._row(pattern) @ self.weights, -30, 30))))

    def adds(self, c: Candidate) -> bool:
        """Beside its likelihood, a candidate needs two labelers for it: a lone vote isn't evidence."""
        return sum(v > 0 for v in c.votes[:4]) >= 2 and self.likely(c.pattern) >= 0.5


def fitted(docs: DataFrame, text: str = "text") -> SpanModel:
    return SpanModel({r.pattern: r.n for r in vote_counts(docs, text).collect()})


def chosen(text: str | None, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; both by kind, then place."""
    found = candidates(text)
    order = lambda s: (KINDS.index(s[0]), s[1])
    base = sorted(((c.kind, c.start, c.end) for c in found if c.base), key=order)
    added: list[tuple[str, int, int]] = []
    for c in sorted((c for c in found if not c.base and model.adds(c)), key=lambda c: (c.start, -c.end)):
        if not added or c.start >= added[-1][2]:
            added.append((c.kind, c.start, c.end))
    return base, sorted(base + added, key=order)


# -- tables


def _mapped(docs: DataFrame, names: dict[str, T.DataType], row: Callable[[str | None], tuple], text: str) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in names.items()])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(t) for t in names.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(v.as_py()) for v in batch.column("__text")]
            columns = [batch.column(c) for c in kept] + [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(trimmed(run), schema)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spotted(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and pii_spans (code points, end exclusive)."""
    row = lambda v: tuple([{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in chosen(v, model))
    return _mapped(docs, {"base_spans": SPANS, "pii_spans": SPANS}, row, text)


def redacted(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    model = model or fitted(docs, text)

    def row(value: str | None) -> tuple:
        if value is None:
            return (None,)
        at, parts = 0, []
        for kind, a, b in sorted(chosen(value, model)[1], key=lambda s: s[1:]):
            if b <= at:
                continue
            parts += [value[at : max(a, at)], f"[{kind.upper()}]"]
            at = b
        return ("".join(parts) + value[at:],)

    return _mapped(docs, {text: T.StringType()}, row, text).select(*docs.columns)


def digest(spans: DataFrame) -> DataFrame:
    """The counts and digests of a table with base_spans and pii_spans."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as bigint)") for k in KINDS[:4]}
    return spans.withColumns({**counts, "base_sha256": F.sha2(written("base_spans").cast("binary"), 256), "spans": written("pii_spans")})
