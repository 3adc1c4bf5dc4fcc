"""UPDATE ... FROM and DELETE as joins.

The matched relation pairs target and source rows by one inner join (Catalyst picks its kind); the merged relation is a
left join that keeps every target row.  The texts of the statement go into SQL as they stand, so that Catalyst resolves
qualifiers; every SET sees the old row.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import store
from quern.operators.store import AnalysisError
from quern.plans.lexer import split, tokens
from quern.plans.statements import DeleteFrom, UpdateFrom


def _qualifier(target: str) -> str:
    return target.split(".")[-1]


def _set_index(spark: SparkSession, s: UpdateFrom) -> dict[int, int]:
    columns = [c.lower() for c in spark.table(store.plain(s.target)).columns]
    for c, _ in s.sets:
        if c.lower() not in columns:
            raise AnalysisError(f"{s.target} has no column {c}; it has {', '.join(columns)}")
    return {columns.index(c.lower()): k for k, (c, _) in enumerate(s.sets)}


def _target(spark: SparkSession, s: UpdateFrom, numbered: bool = False) -> str:
    """The target in SQL under its own name: its named partitions only, and with ``__row`` if rows are to be told apart."""
    if not s.partitions and not numbered:
        return s.target
    where = f" WHERE {partition_condition(spark, s.target, s.partitions)}" if s.partitions else ""
    number = ", monotonically_increasing_id() AS __row" if numbered else ""
    return f"(SELECT *{number} FROM {s.target}{where}) {_qualifier(s.target)}"


def partition_condition(spark: SparkSession, table: str, specs) -> str:
    """An OR over specs of an AND over their keys, values cast to the column's type: it prunes partitions."""
    parts = {c.lower(): c for c in store.partition_columns(spark, table)}
    if not parts:
        raise AnalysisError(f"{table} has no partitions, so no PARTITION can be named")
    types = {f.name: f.dataType.simpleString() for f in spark.table(store.plain(table)).schema}
    for spec in specs:
        for key, _ in spec:
            if key.lower() not in parts:
                raise AnalysisError(f"{key} isn't a partition column of {table} ({', '.join(parts.values())})")
    one = lambda k, v: f"`{parts[k.lower()]}` = CAST('{v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' AS {types[parts[k.lower()]]})"
    return " OR ".join("(" + " AND ".join(one(k, v) for k, v in spec) + ")" for spec in specs)


def matched(spark: SparkSession, s: UpdateFrom) -> DataFrame:
    """A row for each pair: target columns with new values, source columns as ``<c>__t``, old values as ``src_<c>``."""
    target, at = spark.table(store.plain(s.target)), _set_index(spark, s)
    new = "".join(f", ({e}) AS __s{k}" for k, (_, e) in enumerate(s.sets))
    wide = spark.sql(f"SELECT *{new} FROM {_target(spark, s)}, {s.relation} WHERE {s.condition}")
    n, names = len(target.columns), wide.columns
    source = names[n : len(names) - len(s.sets)]
    wide = wide.toDF(*(f"c{k}" for k in range(len(names))))
    value = lambda i: F.col(f"c{len(names) - len(s.sets) + at[i]}").cast(target.schema[i].dataType) if i in at else F.col(f"c{i}")
    columns = [value(i).alias(c) for i, c in enumerate(target.columns)] + [F.col(f"c{n + i}").alias(f"{c}__t") for i, c in enumerate(source)]
    return wide.select(*columns, *(F.col(f"c{i}").alias(f"src_{target.columns[i]}") for i in at))


def joined(relation: str) -> str:
    """A FROM list as one chain of joins, in which qualifiers keep their meaning: commas are cross joins, lateral views lateral ones."""
    own = tokens(relation)
    views = [k for k, t in enumerate(own[:-1]) if t.depth == 0 and t.upper == "LATERAL" and own[k + 1].upper == "VIEW"]
    head = relation[: own[views[0]].start] if views else relation
    chain = " CROSS JOIN ".join(split(head))
    for k, end in zip(views, [*views[1:], len(own)], strict=False):
        at = k + 2
        outer = own[at].upper == "OUTER"
        opening = next(i for i in range(at, end) if own[i].text == "(")
        closing = next(i for i in range(opening + 1, end) if own[i].text == ")" and own[i].depth == own[opening].depth)
        call = relation[own[at + outer].start : own[closing].end]
        alias, names = own[closing + 1].text, [t.text for t in own[closing + 2 : end] if t.upper != "AS" and t.text != ","]
        columns = f"({', '.join(names)})" if names else ""
        chain += f" LEFT JOIN LATERAL {call} AS {alias}{columns} ON true" if outer else f" CROSS JOIN LATERAL {call} AS {alias}{columns}"
    return chain


ON_MULTIPLE = ("error", "first", "duplicate")


def merged(spark: SparkSession, s: UpdateFrom, on_multiple: str = "error", order: str | None = None) -> DataFrame:
    """Every target row (of the named partitions) in the target's schema, with new values where the condition holds.

    ``on_multiple``: what a target row with several matches does: ``error`` (when the plan runs), ``first`` (the first match by
    ``order``, an ORDER BY list over both sides), or ``duplicate`` (a row for each).
    """
    if on_multiple not in ON_MULTIPLE:
        raise AnalysisError(f"on_multiple is one of {', '.join(ON_MULTIPLE)}")
    if (on_multiple == "first") != bool(order):
        raise AnalysisError("an order is needed to take the first of several matches, and for nothing else")
    target, at, q = spark.table(store.plain(s.target)), _set_index(spark, s), _qualifier(s.target)
    relation, first = joined(s.relation), on_multiple == "first"
    new = ", ".join(f"CASE WHEN __mf.__m THEN ({e}) ELSE {q}.`{target.columns[i]}` END AS __s{k}" for i, (k, (_, e)) in zip(at, enumerate(s.sets), strict=True))
    rank = f", row_number() OVER (PARTITION BY {q}.__row ORDER BY {order}) AS __rank" if first else ""
    # the one scalar counts matches by target row, in the same plan: only matched rows' numbers are shuffled for it
    once = f" WHERE CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM {_target(spark, s, True)} JOIN ({relation}) ON ({s.condition}) GROUP BY {q}.__row)) > 1 THEN CAST(raise_error('rows of {store.plain(s.target)} match several source rows') AS BOOLEAN) ELSE true END" if on_multiple == "error" else ""
    wide = spark.sql(f"SELECT *, {new}{rank} FROM {_target(spark, s, first)} LEFT JOIN ({relation} CROSS JOIN (SELECT true AS __m) __mf) ON ({s.condition}){once}")
    names = [f"c{k}" for k in range(len(wide.columns))]
    wide = wide.toDF(*names)
    if first:
        wide = wide.filter(F.col(names[-1]) == 1)
    begin = len(names) - len(s.sets) - first
    return wide.select(*((F.col(names[begin + at[i]]).cast(f.dataType) if i in at else F.col(names[i])).alias(f.name) for i, f in enumerate(target.schema)))


def strategy(spark: SparkSession, s: UpdateFrom) -> str:
    """How an UPDATE is kept: ``view``, ``partitions`` (those named, or for a store with keys those hit, are rewritten), or ``swap`` (the whole table)."""
    if store.is_view(spark, s.target):
        return "view"
    moves = {c.lower() for c, _ in s.sets} & {c.lower() for c in store.partition_columns(spark, s.target)}
    if s.partitions or store.indexed(spark, s.target) and store.partition_columns(spark, s.target):
        return "swap" if moves else "partitions"
    return "swap"


def _hit(spark: SparkSession, s: UpdateFrom) -> tuple | None:
    """The partitions that hold matched rows, at most as many rows as the table has partitions; None if one has no value to name it by."""
    parts = store.partition_columns(spark, s.target)
    rows = matched(spark, replace(s, sets=())).select(*parts).distinct().collect()
    return None if any(v is None for r in rows for v in r) else tuple(tuple((c, str(r[c])) for c in parts) for r in rows)


def update(spark: SparkSession, s: UpdateFrom, persist: bool = False, on_multiple: str = "error", order: str | None = None) -> DataFrame:
    if not persist:
        return matched(spark, s)
    named = s.partitions if strategy(spark, s) != "partitions" or s.partitions else _hit(spark, s)
    if strategy(spark, s) == "partitions" and named is not None:
        if named:
            store.replace_partitions(merged(spark, replace(s, partitions=named), on_multiple, order), s.target)
        return spark.table(store.plain(s.target))
    whole = merged(spark, s, on_multiple, order)
    if s.partitions:
        outside = spark.sql(f"SELECT * FROM {s.target} WHERE NOT coalesce({partition_condition(spark, s.target, s.partitions)}, false)")
        whole = whole.unionAll(outside)
    store.swap(whole, s.target)
    return spark.table(store.plain(s.target))


def remaining(spark: SparkSession, s: DeleteFrom) -> DataFrame:
    """The target's rows that a DELETE leaves; a condition that is unknown deletes nothing."""
    if s.relation:
        return spark.sql(f"SELECT {_qualifier(s.target)}.* FROM {s.target} LEFT ANTI JOIN ({joined(s.relation)}) ON ({s.condition or 'true'})")
    return spark.sql(f"SELECT * FROM {s.target} WHERE NOT coalesce(({s.condition or 'true'}), false)")


def delete(spark: SparkSession, s: DeleteFrom) -> DataFrame:
    store.swap(remaining(spark, s), s.target)
    return spark.table(store.plain(s.target))
