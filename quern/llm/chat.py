"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its text is
trainable.  Turns after the last assistant turn, or a conversation without one, make a closing example with nothing to
train, so that the output holds every turn.

The template writes a turn as ``### role: text</turn>`` and a newline.  In roles and texts the characters that could
form a mark are written as a backslash and a letter (backslash: ``\\e``, ``#``: ``\\h``, ``<``: ``\\l``, and in roles
``:`` as ``\\c``), so that marks can't occur inside and reading back is exact.

Defined cases: turns are ordered by number, then role and text, so ties and repeated rows have one order (nulls first); a null role
or text is an empty one; rows without a conv_id make one conversation of their own; empty texts are turns like any other, and an empty
table gives no examples.  Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
TRAINED = "assistant"
_ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def escaped(text: Column, role: bool = False) -> Column:
    for a, b in _ROLE_ESCAPES if role else _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for a, b in reversed(_ROLE_ESCAPES if role else _ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): the trainable span in code points, end exclusive (null: none)."""
    one = conversations.select(
        F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t")
    )
    turns = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(": "))
    written = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == TRAINED).alias("trained"), head(t).alias("head"), escaped(t["text"]).alias("body"))).alias("w"),
    )
    n = F.size("w")
    # the closing example stands at place n, after the last turn
    ends = F.filter(F.sequence(F.lit(0), n), lambda k: F.when(k == n, ~F.element_at("w", -1)["trained"]).otherwise(F.get("w", k)["trained"]))
    exploded = written.select("conv_id", "w", F.posexplode(ends).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    own = F.get("w", F.col("at"))
    parts = exploded.select("conv_id", "example", before.alias("context"), own["head"].alias("head"), own["body"].alias("body"))
    return parts.select(
        "conv_id",
        F.col("example").cast("long"),
        F.concat("context", F.when(F.col("head").isNull(), F.lit("")).otherwise(F.concat("head", "body", F.lit(END)))).alias("formatted"),
        (F.length("context") + F.length("head")).cast("long").alias("loss_start"),
        (F.length("context") + F.length("head") + F.length("body")).cast("long").alias("loss_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars) from a table of examples alone; turns holds (role, text)."""
    trained = F.when(F.col("loss_start").isNotNull(), F.expr("substring(formatted, int(loss_start + 1), int(loss_end - loss_start))"))
    one = formatted.select("conv_id", "example", "formatted", trained.alias("trained"))
    # the longest example holds every turn
    whole = one.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("whole"), F.sort_array(F.collect_list(F.when(F.col("trained").isNotNull(), F.struct("example", "trained")))).alias("replies"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    pieces = F.filter(F.split("whole", END), lambda p: p != "")
    role = lambda p: unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), ": ", 1), True)
    text = lambda p: unescaped(F.substr(p, F.instr(p, F.lit(": ")) + 2))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    return whole.select("conv_id", F.size(pieces).cast("long").alias("n_turns"), turns.alias("turns"), unescaped(F.array_join(F.transform("replies", lambda r: r["trained"]), "")).alias("loss_text"), "formatted_chars")


def digest(back: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "n_turns", F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
