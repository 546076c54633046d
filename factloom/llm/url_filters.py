"""URL filters: host and path rules, then gradient-boosted trees on lexical features. DataFrame functions only.

Features of a url: length, depth, digit ratio, entropy of its characters, number of parameters, hyphens and labels of the host, and
statistics of its suffixes: the smoothed share of blocked urls among labelled ones with the same last host label, last two labels, and
first path segment (for the fit of trees, among the urls of the other folds). Boosting: Newton steps on logistic loss over a histogram of each feature, fitted by the driver on a bounded
sample of labelled urls (at most SAMPLE distinct ones, the least by hash; at most SUFFIXES values of each suffix). The trees become one
Spark expression, so scoring stays in the scan's stage and shuffles nothing.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; its features are those of
an empty text. Without labelled urls of both kinds the method's verdict is the common one (allow without any). A rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins. Of rules of equal length the last by name wins; a url of any length is
judged whole; an empty table gives an empty result. Rows, also repeated ones, are returned each; a null page_id stays; other columns are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

SAMPLE, SUFFIXES, FOLDS = 20_000, 256, 5
ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 16, 3, 0.4, 24, 8.0, 1.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))
NAMES = ("length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "rate_top", "rate_site", "rate_path")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(name, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest ends up outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _suffixes(host: Column, path: Column) -> tuple[Column, Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, r"^/([^/]*)", 1)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that need no statistics, in the order of NAMES."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    #: Runs of one character in sorted order have that character's count as length.
    seen = F.transform(F.array_distinct(F.split(u, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n))
    entropy = F.aggregate(seen, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return [F.length(u).cast("double"), count(path, "/").cast("double"), F.length(F.regexp_replace(u, "[^0-9]", "")) / n, F.round(entropy, 6), F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"), count(host, "-").cast("double"), count(host, ".").cast("double")]


class Model:
    """Trees as nested (feature, threshold, left, right) or a leaf's value; rates: for each suffix its values' shares."""

    def __init__(self, base: float, trees: list, rates: list[dict[str, float]], mean: float):
        self.base, self.trees, self.rates, self.mean = base, trees, rates, mean

    def features(self, url: Column, host: Column, path: Column) -> list[Column]:
        out = lexical(url, host, path)
        for column, known in zip(_suffixes(host, path), self.rates, strict=True):
            by_value: dict[float, list[str]] = {}
            for k, v in known.items():
                by_value.setdefault(v, []).append(k)
            rate = F.lit(self.mean)
            for v, keys in sorted(by_value.items()):
                rate = F.when(column.isin(keys), F.lit(v)).otherwise(rate)
            out.append(rate)
        return out

    def margin(self, features: list[Column]) -> Column:
        def grow(tree):
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, t, left, right = tree
            return F.when(features[f] <= t, grow(left)).otherwise(grow(right))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + grow(tree)
        return out


def _boost(rows: list[list[float]], y: list[int], n: list[float]) -> tuple[float, list]:
    """(base, trees) by Newton boosting on histograms; rows: features, y: blocked, n: weights."""
    total, blocked = sum(n), sum(a * b for a, b in zip(y, n, strict=True))
    p = min(max(blocked / total, 1e-3), 1 - 1e-3) if total else 1e-3
    base = math.log(p / (1 - p))
    if not total or blocked in (0, total):
        return base, []
    cuts = []
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        cuts.append(values[:-1] if len(values) <= BINS else sorted({values[len(values) * i // BINS] for i in range(1, BINS)} - {values[-1]}))
    bins = [[sum(v > c for c in cuts[f]) for f, v in enumerate(r)] for r in rows]
    margin, trees = [base] * len(rows), []
    for _ in range(ROUNDS):
        q = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margin]
        g = [w * (a - b) for w, a, b in zip(n, q, y, strict=True)]
        h = [w * a * (1 - a) for w, a in zip(n, q, strict=True)]

        def grow(ids, depth):
            sg, sh, sn = sum(g[i] for i in ids), sum(h[i] for i in ids), sum(n[i] for i in ids)  # noqa: B023
            best = (1e-6, None, None)
            if depth < DEPTH and sn >= 2 * LEAST:
                for f, c in enumerate(cuts):
                    hist = [[0.0, 0.0, 0.0] for _ in range(len(c) + 1)]
                    for i in ids:
                        x = hist[bins[i][f]]
                        x[0] += g[i]  # noqa: B023
                        x[1] += h[i]  # noqa: B023
                        x[2] += n[i]
                    a = b = m = 0.0
                    for k in range(len(c)):
                        a, b, m = a + hist[k][0], b + hist[k][1], m + hist[k][2]
                        if m >= LEAST and sn - m >= LEAST:
                            gain = a * a / (b + RIDGE) + (sg - a) ** 2 / (sh - b + RIDGE) - sg * sg / (sh + RIDGE)
                            if gain > best[0]:
                                best = (gain, f, k)
            if best[1] is None:
                value = -RATE * sg / (sh + RIDGE)
                for i in ids:
                    margin[i] += value
                return round(value, 9)
            _, f, k = best
            return (f, cuts[f][k], grow([i for i in ids if bins[i][f] <= k], depth + 1), grow([i for i in ids if bins[i][f] > k], depth + 1))

        trees.append(grow(list(range(len(rows))), 0))
    return base, trees


def _rates(rows, mean: float) -> list[dict[str, float]]:
    """For each suffix the smoothed share of blocked urls of its most frequent values."""
    out = []
    for k in range(3):
        seen: dict[str, list[int]] = {}
        for y, _, s, _ in rows:
            x = seen.setdefault(s[k], [0, 0])
            x[0] += y
            x[1] += 1
        most = sorted(seen, key=lambda v: (-seen[v][1], v))[:SUFFIXES]
        out.append({v: round((seen[v][0] + 10 * mean) / (seen[v][1] + 10), 2) for v in most if seen[v][1] >= 5})
    return out


def fit(labelled: DataFrame) -> Model:
    """labelled: url, blocked (0 or 1). A bounded sample is read, see SAMPLE."""
    urls = labelled.filter("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    urls = urls.orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    host, path = host_and_path(F.col("url"))
    rows = urls.withColumns({"h": host, "p": path}).select("blocked", F.array(*lexical(F.col("url"), F.col("h"), F.col("p"))).alias("x"), F.array(*_suffixes(F.col("h"), F.col("p"))).alias("s"), F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = [(r["blocked"], list(r["x"]), list(r["s"]), r["fold"]) for r in rows.collect()]
    mean = sum(r[0] for r in rows) / len(rows) if rows else 0.0
    rates = _rates(rows, mean)
    #: A row's own label is not among those that its suffixes' shares are made of when trees are fitted.
    others = [_rates([r for r in rows if r[3] != f], mean) for f in range(FOLDS)]
    mean = round(mean, 2)
    same: dict[tuple, list[float]] = {}
    for y, x, s, f in rows:
        same.setdefault((y, *x, *(others[f][k].get(s[k], mean) for k in range(3))), []).append(1.0)
    keys = sorted(same)
    base, trees = _boost([list(k[1:]) for k in keys], [k[0] for k in keys], [sum(same[k]) for k in keys])
    return Model(base, trees, rates, mean)


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, margin of each row of pages (page_id, url).

    labelled: url, blocked; by default the urls of pages that a rule decides.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.filter("r is not null").select("url", (F.col("r.verdict") == "block").cast("int").alias("blocked"))
    model = fit(labelled)
    names = {f"f_{n}": c for n, c in zip(NAMES, model.features(F.col("url"), F.col("host"), F.col("path")), strict=True)}
    scored = rows.withColumns(names).withColumn("margin", model.margin([F.col(n) for n in names]))
    verdict = F.coalesce("r.verdict", F.when(F.col("margin") >= 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), F.round("margin", 6).alias("margin"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of pages, judged by RULES, then by trees."""
    return judged(B.table(spark, sf_dir, "pages"))
