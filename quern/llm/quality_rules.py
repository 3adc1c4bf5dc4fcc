"""Line-first quality rules, with DataFrame functions only.

Every line is held against punctuation, navigation and boilerplate rules; lines that fail are removed, and a document
is rejected when too much of its text goes with them.  Base measures of the whole text come along.

Defined cases: a null text counts as an empty one, which has no words and is rejected; a line without words is never
kept nor counted; rows are judged one by one, so repeated rows get repeated results and an empty table an empty result;
columns of the input whose names clash with the measures are replaced by them, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base measures.
RARE_SPACE = "[\\\\x09\\\\x0B-\\\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document must keep this share of the characters of its lines.
MIN_KEPT_SHARE = 0.5
#: A line fails with a share of characters above these.
MAX_SYMBOL_SHARE, MAX_UPPER_SHARE, MAX_BAR_SHARE = 0.08, 0.5, 0.05
#: A line of at least LONG_LINE words fails when fewer than this share of its words are distinct.
LONG_LINE, MIN_DISTINCT_SHARE = 12, 0.3
#: A line without closing punctuation is taken for navigation if it is as short as this.
NAV_WORDS = 4
BOILERPLATE = (
    "all rights reserved", "licensed under", "creative commons", "copyright", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "click here", "read more", "sign in", "log in", "subscribe", "newsletter", "share this", "back to top", "skip to content", "lorem ipsum",
)
CLOSING = "[.!?:;…。！？\"”’)»\\\\]]$"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "kept_share", "kept", "clean_text")


def _let(name: str, value: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words of a string ``t``, and the count of words in 3-word windows that occur twice.  Hashes find the few windows that
#: may repeat; those are sorted as strings, so that equal neighbours mark their positions, and each marked position covers
#: the words of its window that the marked position before it does not.  Only a text with more repeated hashes than
#: FEW_REPEATS sorts all its windows.
FEW_REPEATS = 48
#: Of a line, which holds no line feed; ``rare`` says whether its text has any separator but spaces and line feeds, which few have.
_WORDS = "filter(split(if(rare, translate({t}, '\\t\\u000B\\u000C\\r', '    '), {t}), ' '), x -> x <> '')"
_STARTS = "slice(sequence(0, size(w)), 1, greatest(size(w) - 2, 0))"
_HASHES = "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, p) -> xxhash64(x, get(w, p + 1), get(w, p + 2)))"
_TWICE = "array_distinct(filter(hs, (x, k) -> x = get(hs, k - 1)))"
_CANDIDATES = f"if(size(du) <= {FEW_REPEATS}, filter(ps, p -> array_contains(du, get(h, p))), ps)"
_WINDOWS = "sort_array(transform(cs, p -> struct(concat(get(w, p), ' ', get(w, p + 1), ' ', get(w, p + 2)) as g, p as p)))"
_MARKED = "sort_array(transform(filter(s, (e, k) -> get(s, k - 1).g = e.g or get(s, k + 1).g = e.g), e -> e.p))"
_COVERED = "aggregate(d, struct(0 as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)"


def _repeat_words() -> str:
    exact = _let("cs", _CANDIDATES, _let("s", _WINDOWS, _let("d", _MARKED, _COVERED)))
    found = _let("hs", "sort_array(h)", _let("du", _TWICE, _let("ps", _STARTS, exact)))
    return "cast(" + _let("h", _HASHES, f"if(size(array_distinct(h)) = size(h), 0, {found})") + " as bigint)"


def _line_fails(line: str, words: str) -> str:
    """One quick scan finds the lines that can break a rule on characters: half of them in upper case needs two together."""
    shares = [f"regexp_count({line}, '[#*$%&<>]') > {MAX_SYMBOL_SHARE} * length({line})", f"regexp_count({line}, '[|]') > {MAX_BAR_SHARE} * length({line})", f"regexp_count({line}, '\\\\p{{Lu}}') > {MAX_UPPER_SHARE} * length({line})"]
    rules = [
        f"size({words}) <= {NAV_WORDS} and not rtrim({line}) rlike '{CLOSING}'",
        f"{line} rlike '[#*$%&<>|]|\\\\p{{Lu}}{{2}}' and ({' or '.join(shares)})",
        f"size({words}) >= {LONG_LINE} and size(array_distinct({words})) < {MIN_DISTINCT_SHARE} * size({words})",
        "size(ph) > 0 and " + _let("low", f"lower({line})", "exists(ph, x -> contains(low, x))"),
    ]
    return " or ".join(f"({rule})" for rule in rules)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES."""
    t = f"coalesce(`{text}`, '')"
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    phrases = "array('" + "', '".join(BOILERPLATE) + "')"
    lines = f"transform(split({t}, '\\n'), l -> struct(l as l, {_WORDS.format(t='l')} as v))"
    found = _let("low", f"lower({t})", f"filter({phrases}, x -> contains(low, x))")
    judged = _let("ph", found, f"transform(filter(ls, e -> size(e.v) > 0), e -> named_struct('l', e.l, 'bad', {_line_fails('e.l', 'e.v')}, 'c', cast(length(e.l) as bigint)))")
    base = _let("w", "flatten(transform(ls, e -> e.v))", "named_struct('n', cast(size(w) as bigint), 'c', cast(length(array_join(w, '')) as bigint), 'r', " + _repeat_words() + ")")
    # the measures come out of a generator, below which no filter on them is pushed: it would compute them again for each use
    one = docs.select(*kept, F.expr(t).alias("__t"), F.explode(F.array(F.expr(_let("rare", f"{t} rlike '{RARE_SPACE}'", _let("ls", lines, f"struct({base} as b, {judged} as j)"))))).alias("__bj"))
    one = one.select(*kept, "__t", F.col("__bj.b").alias("__b"), F.col("__bj.j").alias("__j"))
    shares = "aggregate(__j, struct(0L as good, 0L as bad_n, 0L as c), (a, e) -> struct(a.good + if(e.bad, 0, e.c) as good, a.bad_n + if(e.bad, 1, 0) as bad_n, a.c + e.c as c))"
    two = one.select(*kept, "__t", "__b", "__j", F.expr(shares).alias("__s"))
    out = two.select(
        *kept,
        F.expr("__b.n").alias("n_words"),
        F.expr("__b.c").alias("word_chars"),
        F.expr(f"regexp_count(__t, '[{SYMBOLS}]')").cast("long").alias("n_symbols"),
        F.expr("size(__j) - size(array_distinct(transform(__j, e -> e.l)))").cast("long").alias("n_dup_lines"),
        F.expr("__b.r").alias("n_repeat_words"),
        F.expr(f"__b.n < {MIN_WORDS} or 100 * __b.r > {MAX_REPEAT_PERCENT} * __b.n").alias("base_failed"),
        F.expr("cast(size(__j) as bigint)").alias("n_lines"),
        F.expr("__s.bad_n").alias("n_failed_lines"),
        F.expr("if(__s.c = 0, 0D, __s.good / __s.c)").alias("kept_share"),
        F.expr("array_join(transform(filter(__j, e -> not e.bad), e -> e.l), '\\n')").alias("clean_text"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT_SHARE))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass, whole, with their own columns."""
    return measured(docs).filter("kept").select(*docs.columns)
