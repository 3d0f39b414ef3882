"""Inventories, differences, duplicates, references, lineage, integrity."""

from __future__ import annotations

import hashlib

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of every path of two revisions: added, removed, changed or same."""
    j = old.select("path", F.col("sha").alias("a")).join(new.select("path", F.col("sha").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("status"))


def duplicates(files: DataFrame) -> DataFrame:
    """path, sha, duplicate: the first path of a content is no duplicate. The first path is an aggregate, so a content with many paths meets in no task."""
    first = files.groupBy("sha").agg(F.min("path").alias("first"))
    return files.join(first, "sha").select("path", "sha", (F.col("path") != F.col("first")).alias("duplicate"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose value differs, or is on one side only."""
    return before.join(after, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def effective(refs: DataFrame) -> DataFrame:
    """crop, label, seq: crops with one label only, the last entry of each."""
    g = refs.groupBy("crop").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.max("seq").alias("seq"))
    return g.filter("label = other").select("crop", "label", "seq")


def lineage(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, new, split (the old cluster has several successors), merged (the new one has several parents), by shared members."""
    m = old.join(new, key).select("old", "new").distinct()
    s, p = m.groupBy("old").agg(F.count("*").alias("s")), m.groupBy("new").agg(F.count("*").alias("p"))
    return m.join(s, "old").join(p, "new").select("old", "new", (F.col("s") > 1).alias("split"), (F.col("p") > 1).alias("merged"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, counted in one pass; unknown counts as broken."""
    one = rows.agg(*(F.count(F.when(~F.coalesce(p, F.lit(False)), 1)).alias(n) for n, p in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("r")).select("r.*")


def fail_closed(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows; reading one that breaks a rule raises an error that names it."""
    checks = [F.when(~F.coalesce(p, F.lit(False)), F.raise_error(F.lit(f"broken rule: {n}")).cast("boolean")).otherwise(True) for n, p in rules.items()]
    return rows.filter(reduce(lambda a, b: a & b, checks))


def adjusted_rand(rows: DataFrame) -> DataFrame:
    """ari: agreement of two labellings a and b, from their contingency table."""
    c = rows.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    ij = c.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("t"))
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s{k}"))
    j = ij.crossJoin(side("a")).crossJoin(side("b"))  # three single rows
    expected = F.col("sa") * F.col("sb") / two(F.col("t"))
    return j.select(F.try_divide(F.col("ij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("first", F.row_number().over(w) == 1)


def fingerprint(rows: DataFrame, content: str) -> tuple[int, str]:
    """How many distinct contents there are, and the digest of them in order, each on a line. They are sorted side by
    side and pass the driver one partition after the other, as a digest is taken in order."""
    digest, n = hashlib.sha256(), 0
    for r in rows.select(F.col(content).alias("c")).filter("c IS NOT NULL").distinct().sort("c").toLocalIterator(True):
        digest.update(("\n" * (n > 0) + r["c"]).encode())
        n += 1
    return n, digest.hexdigest()
