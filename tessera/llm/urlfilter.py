"""URL filters (operator 4): block and allow rules, and for all other urls logistic regression on hashed character
n-grams of host and path, trained from a small labelled url table.

DataFrame functions only. Training is gradient descent: each step is one Spark aggregation over the labelled urls,
which gives at most one number for each of `buckets` features; the weights are a literal array of that size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, kept, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = (3, 4)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. A
    null url or one without :// has empty ones."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equal ones the first in alphabetical order), else null. A rule `host/path`
    fits its host and all subdomains, if the path starts with the rule's. The rules are one array in that order, so host
    and path, which should be columns, are named but twice."""
    entries = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, start = rule.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        entries.append(F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.lit("/" + start).alias("start")))
    if not entries:
        return F.lit(None).cast("string")
    of_host = F.concat(F.lit("."), host)
    return F.get(F.filter(F.array(*entries), lambda r: F.endswith(of_host, F.concat(F.lit("."), r["name"])) & F.startswith(path, r["start"])), 0)["rule"]


def by_rule(rule: Column, values: dict[str, object]) -> Column:
    """The value of a rule; null without one."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), rule)


def features(host: Column, path: Column, buckets: int) -> Column:
    """The distinct buckets of the n-grams of both; every url has at least one."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(text.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*map(grams, ORDERS)))


@dataclass(frozen=True)
class UrlModel:
    weights: list[float]
    intercept: float

    def score(self, found: Column) -> Column:
        """The probability of label 1 for an array of feature buckets."""
        literal = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")  # folded to a constant
        total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(literal, i))
        return 1 / (1 + F.exp(-(total / F.sqrt(F.size(found).cast("double")) + self.intercept)))


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_rows: int = 2000, buckets: int = 2048, rounds: int = 20, rate: float = 1.0, penalty: float = 1e-4) -> UrlModel:
    """labelled: url and label (0 or 1; rows with another label or a null are left out); about max_rows rows are used,
    chosen by a hash of the url. Without labelled rows every score is one half."""
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("label")).where("url is not null and label in (0, 1)")
    host, path = host_and_path(F.col("url"))
    parts = bounded_sample(rows, "url", max_rows).select("label", host.alias("host"), path.alias("path"))
    table = written(parts.select("label", features(F.col("host"), F.col("path"), buckets).alias("found")), "url-features").coalesce(1 + max_rows // 20_000)  # of few rows one task is the fastest
    n = table.count()
    weights, intercept = [0.0] * buckets, 0.0
    seen, seen_intercept = [1e-8] * buckets, 1e-8
    for _ in range(rounds if n else 0):
        error = UrlModel(weights, intercept).score(F.col("found")) - F.col("label")
        rated = table.select("found", error.alias("error"))  # one score a row, not one for each of its features
        # Every row is in the bucket -1 too, with its whole error: the slope of the intercept.
        entries = rated.select("error", F.size("found").cast("double").alias("size"), F.explode(F.concat(F.array(F.lit(-1)), "found")).alias("bucket"))
        share = F.when(F.col("bucket") < 0, F.col("error")).otherwise(F.col("error") / F.sqrt("size"))
        steps = entries.groupBy("bucket").agg(F.sum(share).alias("slope")).collect()
        slope0 = next(r["slope"] for r in steps if r["bucket"] < 0) / n
        for row in (r for r in steps if r["bucket"] >= 0):
            slope = row["slope"] / n + penalty * weights[row["bucket"]]
            seen[row["bucket"]] += slope * slope
            weights[row["bucket"]] -= rate * slope / math.sqrt(seen[row["bucket"]])
        seen_intercept += slope0 * slope0
        intercept -= rate * 0.5 * slope0 / math.sqrt(seen_intercept)
    return UrlModel(weights, intercept)


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame, keep: list[str], url: str = "url", threshold: float = 0.5, **training: int) -> DataFrame:
    """The columns `keep`, host, path, rule, score and verdict (allow or block) for each row of pages.

    rules: `host/path` -> allow or block. The longest fitting rule decides, else the model: block from `threshold` on.
    labelled: url, label (1: block). Null and empty urls have empty host and path and are judged by the model; very long
    ones are read whole. Repeated rows are judged each; an empty table gives no rows. A kept column with the name of a
    result is called kept_<name>.
    """
    model = train(labelled, **training)
    held = [f"held_{i}" for i in range(len(keep))]
    own = pages.select(*[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)], F.col(url).alias("judged_url"))
    host, path = host_and_path(F.col("judged_url"))
    parts = own.select(*held, host.alias("own_host"), path.alias("own_path"))
    host, path = F.col("own_host"), F.col("own_path")
    ruled = parts.select(*held, host, path, matching_rule(host, path, rules).alias("own_rule"), model.score(features(host, path, len(model.weights))).alias("own_score"))
    verdict = F.coalesce(by_rule(F.col("own_rule"), rules), F.when(F.col("own_score") >= threshold, "block").otherwise("allow"))
    found = {"host": host, "path": path, "rule": F.col("own_rule"), "score": F.col("own_score"), "verdict": verdict}
    names = pages.select(*kept(keep, list(found))).columns
    return ruled.select(*[F.col(h).alias(c) for c, h in zip(names, held, strict=True)], *[c.alias(name) for name, c in found.items()])


def labelled_by_rules(pages: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """url, label: the urls that a rule judges, as a labelled table (1: block)."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    ruled = parts.select("url", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    return ruled.select("url", by_rule(F.col("rule"), {r: int(v == "block") for r, v in rules.items()}).alias("label")).where("label is not null")
