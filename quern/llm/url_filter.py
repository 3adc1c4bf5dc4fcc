"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule names a host (and fits its subdomains) and the beginning of a path; of the rules that fit, the longest decides.
The trees judge the rest.  They are trained from labelled urls, a table of (url, blocked) that the caller gives; ``example_labels``
makes one where there is none: urls of pages whose host holds a term of a seed list are blocked, their others aren't, and urls
written by rule from word lists are added for both, so that the trees meet the forms of hosts, paths and parameters which a seed
list doesn't name.  (The rules are no labels: they speak of languages and domains.)  The terms are never features; those are
lengths, depth, digits, entropy, parameters and statistics of the host's suffix (last two labels).  The sample bounds what the
trees are fitted on; the statistics count all distinct labelled urls of every suffix, and are joined to the sample and to the
pages.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by its features
like any other; very long urls are measured whole; urls that repeat are judged alike (a url that is labelled both ways is
blocked, and one counts once in sample and statistics); without labelled urls of both verdicts all others are allowed; an empty
table gives an empty result; other columns stay and clashing names are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import salted_lookup, written

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Terms of hosts that label a url as blocked.
SEED_TERMS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "loan", "betting", "lottery", "poker", "replica", "jackpot", "payday")
#: Written labels, and what their words are made of.
WRITTEN = 4_000
_SYLLABLES = ("ba", "ther", "in", "lo", "ti", "re", "mon", "sta", "ver", "ne", "ard", "col", "ing", "pra", "den", "wil", "ost", "th", "sh", "ble", "ca", "rum")
#: Bound of the labelled sample; trees, their depth, the cuts tried for a feature, and the step.
MAX_LABELLED, TREES, LEVELS, CUTS, RATE = 20_000, 40, 3, 16, 0.2
#: Urls of the overall share of blocked ones that are added to each suffix.
PRIOR = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits (null: none)."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in ordered]
    name = reduce(lambda c, k: c.when(fits[k], ordered[k][0] + ordered[k][1]), range(1, len(ordered)), F.when(fits[0], ordered[0][0] + ordered[0][1]))
    verdict = reduce(lambda c, k: c.when(fits[k], ordered[k][2]), range(1, len(ordered)), F.when(fits[0], ordered[0][2]))
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.array_sort(F.split(u, ""))
    # entropy from the run lengths of the sorted characters
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when(k > 0, (k / n) * F.log2(F.greatest(k, F.lit(1)) / n)).otherwise(0.0))
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "labels": F.size(F.split(host, "\\.")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "host_digits": F.regexp_count(host, F.lit("[0-9]")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "parameters": F.when(query == "", 0.0).otherwise((F.regexp_count(query, F.lit("&")) + 1).cast("double")),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": F.startswith(u, F.lit("https:")).cast("double"),
        "upper_ratio": F.regexp_count(u, F.lit("[A-Z]")) / n,
        "entropy": entropy,
    }


class Trees:
    """Boosted trees for the probability of ``block``; fitted on the driver from a bounded sample, applied as one SQL expression."""

    def __init__(self, names: list[str], rows: np.ndarray, suffixes: list[str], blocked: np.ndarray, trees: int = TREES, levels: int = LEVELS, seen: dict[str, tuple[float, float]] | None = None):
        self.names = [*names, "suffix_count", "suffix_blocked"]
        share = float(blocked.mean()) if len(blocked) else 0.0
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        #: Table of (__s, __n, __b), which are a suffix and its two statistics, and the statistics of a suffix that isn't in it.
        self.statistics: DataFrame | None = None
        self.unseen = (0.0, share)
        self.trees: list = []
        if not 0 < share < 1:
            return
        stats = np.array([(seen or {}).get(s, self.unseen) for s in suffixes])
        x = np.concatenate([rows, stats], 1)
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # bin <= k: value <= cut k
        score = np.full(len(x), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree, fit = self._grown(binned, cuts, blocked - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(x)), levels, np.zeros(len(x)))
            self.trees.append(tree)
            score += fit

    def _grown(self, binned, cuts, gradient, curve, rows, levels, fit):
        g, h = gradient[rows].sum(), curve[rows].sum()
        best = (1e-3, None, None)
        if levels and len(rows) >= 20:
            for k, own in enumerate(cuts):
                gs, hs = (np.bincount(binned[rows, k], w[rows], len(own) + 1).cumsum()[:-1] for w in (gradient, curve))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] is None:
            value = float(RATE * g / (h + 1))
            fit[rows] = value
            return value, fit
        _, k, cut = best
        left = binned[rows, k] <= cut
        low, _ = self._grown(binned, cuts, gradient, curve, rows[left], levels - 1, fit)
        high, _ = self._grown(binned, cuts, gradient, curve, rows[~left], levels - 1, fit)
        return (self.names[k], float(cuts[k][cut]), low, high), fit

    def _sql(self, tree) -> str:
        if isinstance(tree, float):
            return f"{tree!r}D"
        name, cut, low, high = tree
        return f"if(__f.{name} <= {cut!r}D, {self._sql(low)}, {self._sql(high)})"

    def probability(self) -> str:
        score = " + ".join([f"{self.bias!r}D", *map(self._sql, self.trees)])
        return f"1 / (1 + exp(-({score})))"


def written_labels(n: int = WRITTEN, seed: int = 17) -> list[tuple[str, float]]:
    """(url, blocked), half of each, by rule: hosts that chain words or mix them with digits, long parameters and deep paths mostly belong to the blocked."""
    rng, out = np.random.default_rng(seed), []
    pick, chance = lambda words: words[rng.integers(len(words))], lambda p: rng.random() < p
    plain = lambda: "".join(pick(_SYLLABLES) for _ in range(rng.integers(2, 4)))
    for k in range(n):
        bad = k % 2 == 1
        word = pick(SEED_TERMS) if bad and chance(0.4) else plain()
        if chance(0.8 if bad else 0.06):
            word += "-" + (pick(SEED_TERMS) if bad and chance(0.3) else plain()[: rng.integers(1, 6)]) + ("-" + plain() if bad and chance(0.3) else "")
        if chance(0.35 if bad else 0.03):
            word += str(rng.integers(1, 10_000))
        host = pick(("", "", "www.", "m.", "blog.", "shop.")) + word + pick(("", ".example", ".example")) + pick((".com", ".net", ".org", ".info"))
        path = "/" + pick(("en", "de", "fr", "es", "news", "blog")) + f"/{rng.integers(10_000)}" + pick(("", "/", ".html"))
        if chance(0.35 if bad else 0.05):
            path += "/" + "/".join(plain() for _ in range(rng.integers(1, 5)))
        query = ""
        if chance(0.5 if bad else 0.3):
            query = "?" + "&".join(f"{plain()[:4]}={rng.integers(1 << 30) if bad else rng.integers(100)}" for _ in range(rng.integers(2, 6) if bad else rng.integers(1, 3)))
        out.append((pick(("http", "https")) + "://" + host + path + query + pick(("", "", "#top")), float(bad)))
    return out


def example_labels(pages: DataFrame, url: str = "url", terms=SEED_TERMS, n: int = WRITTEN) -> DataFrame:
    """Labelled urls (url, blocked): those of pages by the seed list, and written ones."""
    own = pages.select(F.col(url).alias("url")).filter("url is not null")
    own = own.withColumn("blocked", host_and_path(F.col("url"))[0].rlike("|".join(terms)).cast("double"))
    return own.union(pages.sparkSession.createDataFrame(written_labels(n), own.schema))


def fitted(labelled: DataFrame, most: int = MAX_LABELLED) -> Trees:
    """From labelled urls (url, blocked: 1 or 0); the trees learn from at most ``most`` of them, half of each verdict, by the hash of the url."""
    one = labelled.filter("url is not null and blocked in (0, 1)").groupBy(F.col("url").alias("u")).agg(F.max("blocked").cast("double").alias("y"))
    host, path = host_and_path(F.col("u"))
    rows = one.withColumns({"h": host, "p": path})
    features = lexical(F.col("u"), F.col("h"), F.col("p"))
    suffix = suffix_of(F.col("h")).alias("__s")
    counts, _ = written(rows.groupBy(suffix).agg(F.count("*").alias("n"), F.sum("y").alias("b")), "suffixes")
    n, b = counts.agg(F.sum("n"), F.sum("b")).first()
    share = b / n if n else 0.0
    statistics = counts.select("__s", F.col("n").alias("__rows"), F.log1p("n").alias("__n"), ((F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).alias("__b"))
    drawn = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("u"), "u").limit(most // 2) for y in (1.0, 0.0)]
    sample = drawn[0].union(drawn[1]).select("u", suffix, "y", *(c.alias(n) for n, c in features.items()))
    found = statistics.join(F.broadcast(sample), "__s").orderBy(F.desc("y"), F.xxhash64("u"), "u").drop("u").toArrow()
    x = np.stack([found.column(n).to_numpy() for n in features], 1) if found.num_rows else np.zeros((0, len(features)))
    seen = dict(zip(found.column("__s").to_pylist(), zip(found.column("__n").to_pylist(), found.column("__b").to_pylist(), strict=True), strict=True))
    trees = Trees(list(features), x, found.column("__s").to_pylist(), found.column("y").to_numpy() if found.num_rows else np.zeros(0), seen=seen)
    trees.statistics, trees.unseen = statistics, (0.0, share)
    return trees


def judged(pages: DataFrame, trees: Trees, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, block_probability (of the trees) and verdict."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "block_probability", "verdict")]
    host, path = host_and_path(F.col(url))
    one = pages.select(*kept, F.col(url).alias("__u"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    features = lexical(F.col("__u"), F.col("host"), F.col("path"))
    one = salted_lookup(one.withColumn("__s", suffix_of(F.col("host"))), trees.statistics, "__s", F.monotonically_increasing_id(), "__rows")
    known = [F.coalesce(c, F.lit(v)).alias(name) for c, v, name in zip(("__n", "__b"), trees.unseen, trees.names[-2:], strict=True)]
    two = one.select(*kept, "host", "path", name.alias("rule"), verdict.alias("__v"), F.struct(*(c.alias(n) for n, c in features.items()), *known).alias("__f"))
    three = two.select(*kept, "host", "path", "rule", "__v", F.expr(trees.probability()).alias("block_probability"))
    return three.select(*kept, "host", "path", "rule", "block_probability", F.coalesce("__v", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"))
