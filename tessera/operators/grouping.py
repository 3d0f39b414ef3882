"""Matching of vectors against labelled reference banks, with calibrated accept or abstain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, dot
from .blocks import matrix, products
from .skew import group_quantiles, kept, quantiles


def summed(vectors: Column, width: int) -> Column:
    """Element-wise sums of a column of arrays, as an array: one aggregate for each dimension, combined before a shuffle."""
    return F.array(*(F.sum(F.get(vectors, F.lit(i)).cast("double")) for i in range(width)))


def reference_scores(items: DataFrame, refs: DataFrame, top: int = 3) -> DataFrame:
    """k, top_mean (mean of the best `top` cosines), best and novelty of every item; null where there are no references."""
    kind = dict(items.dtypes)["k"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"k": x["k"][:0], "t": []})
        s = np.clip(matrix(x["v"]) @ matrix(y["v"]).T, -1, 1)
        best = -np.sort(-np.partition(s, max(0, s.shape[1] - top), 1)[:, -top:], 1)
        return pd.DataFrame({"k": x["k"], "t": list(best)})

    parts = products(items.select("k", "v"), refs.select("k", "v"), ("k", "k"), run, f"k {kind}, t array<double>")
    s = parts.groupBy("k").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t")), False), 1, top).alias("t"))
    mean = F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return items.select("k").join(s, "k", "left").select("k", mean.alias("top_mean"), F.get("t", F.lit(0)).alias("best"), (1 - F.get("t", F.lit(0))).alias("novelty"))


def label_scores(queries: DataFrame, bank: DataFrame, width: int) -> DataFrame:
    """k, label, centre, individual: cosine to each label's centroid and best reference, without references of the query's own crop.

    queries: k, crop, v; bank: label, crop, v. Centroids are sums less the excluded rows, which an equi-join on the crop
    finds, so no centroid is recomputed. A label whose references are all excluded, or sum to nothing, has no score.
    """
    kinds = dict(queries.dtypes)
    whole = bank.groupBy("label").agg(summed(F.col("v"), width).alias("v"), F.count("*").alias("members"))
    own = bank.groupBy("crop", "label").agg(summed(F.col("v"), width).alias("cut"), F.count("*").alias("n"))
    cuts = queries.select("k", "crop").join(own, "crop").groupBy("k").agg(F.collect_list(F.struct("label", "cut", "n")).alias("own"))
    left = queries.select("k", "crop", "v").join(cuts, "k", "left")
    right = bank.select("label", "crop", "v", F.lit(0).cast("long").alias("members")).union(whole.select("label", F.lit(None).cast(kinds["crop"]), "v", "members"))
    right = right.withColumn("key", F.struct("label", "crop"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"k": [], "label": [], "centre": [], "individual": []}

        def add(rows: np.ndarray, labels: np.ndarray, centre: np.ndarray, individual: np.ndarray) -> None:
            for c, v in zip(out, (x["k"].to_numpy()[rows], labels, centre, individual), strict=True):
                out[c].append(v)

        if len(x) and len(y):
            q = matrix(x["v"])
            sums, refs = y[y["members"] > 0], y[y["members"] == 0].sort_values("label")
            if len(sums):
                t, n, names = matrix(sums["v"]), sums["members"].to_numpy(), sums["label"].to_numpy()
                dots, lengths = q @ t.T, np.broadcast_to(np.sqrt((t * t).sum(1)), (len(q), len(t))).copy()
                left_over = np.broadcast_to(n, lengths.shape).copy()
                at = {name: i for i, name in enumerate(names)}
                for i, mine in enumerate(x["own"]):
                    for o in mine if mine is not None else ():
                        if (j := at.get(o["label"])) is not None:
                            c = t[j] - np.asarray(o["cut"], float)
                            dots[i, j], lengths[i, j], left_over[i, j] = q[i] @ c, np.sqrt(c @ c), n[j] - o["n"]
                ok = (left_over > 0) & (lengths > 1e-12 * np.maximum(left_over, 1))
                i, j = np.nonzero(ok)
                add(i, names[j], np.clip(dots[i, j] / lengths[i, j], -1, 1), np.full(len(i), np.nan))
            if len(refs):
                names, first = np.unique(refs["label"].to_numpy(), return_index=True)
                s = q @ matrix(refs["v"]).T
                s[x["crop"].to_numpy()[:, None] == refs["crop"].to_numpy()[None, :]] = -np.inf
                best = np.maximum.reduceat(s, first, 1)
                i, j = np.nonzero(best > -np.inf)
                add(i, names[j], np.full(len(i), np.nan), np.clip(best[i, j], -1, 1))
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    kind = dict(bank.dtypes)["label"]
    parts = products(left, right, ("k", "key"), run, f"k {kinds['k']}, label {kind}, centre double, individual double", fold=lambda d: d.groupby(["k", "label"], as_index=False, sort=False).max())
    seen = lambda c: F.max(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
    return parts.groupBy("k", "label").agg(seen("centre"), seen("individual")).filter("centre IS NOT NULL AND individual IS NOT NULL")


def margins(scores: DataFrame) -> DataFrame:
    """Adds to each (k, label) what it leads the best other label by, as the smaller of both kinds of score."""
    w = Window.partitionBy("k")

    def rest(c: str) -> Column:
        ordered = F.sort_array(F.collect_list(c).over(w), False)
        return F.when(F.col(c) == F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))).otherwise(F.get(ordered, F.lit(0)))

    return scores.withColumn("wrong", rest("centre")).withColumn("margin", F.least(F.col("centre") - F.col("wrong"), F.col("individual") - rest("individual"))).withColumn("labels", F.count("*").over(w))


def decide(scores: DataFrame, min_sim: float, min_margin: float) -> DataFrame:
    """k, label (null: abstained), sim, margin: the label of the best centroid if both margins support it."""
    w = Window.partitionBy("k").orderBy(F.col("centre").desc(), "label")
    best = margins(scores).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    ok = (F.col("labels") >= 2) & (F.col("centre") >= min_sim) & (F.col("margin") >= min_margin) & (F.col("margin") > 0)
    return best.select("k", F.when(ok, F.col("label")).alias("label"), F.when(F.col("labels") >= 2, F.col("centre")).alias("sim"), F.when(F.col("labels") >= 2, F.col("margin")).alias("margin"))


def calibrate(bank: DataFrame, width: int) -> DataFrame:
    """One row: references used, those of a positive margin, the genuine scores' median, the impostors' 95th percentile and max(.005, 10th percentile of positive margins)."""
    q = bank.select(F.col("crop").alias("k"), "crop", "v", F.col("label").alias("own"))
    m = kept(margins(label_scores(q, bank, width)).join(q.select("k", "own"), "k").filter("label = own AND labels >= 2"))
    impostors = quantiles(m, "wrong", {"min_sim": 0.95})
    genuine = quantiles(m, "centre", {"genuine": 0.5})
    stable = quantiles(m.filter("margin > 0"), "margin", {"low": 0.10})
    one = m.agg(F.count("*").alias("used"), F.count_if(F.col("margin") > 0).alias("stable"))  # all four are one row
    return one.crossJoin(impostors).crossJoin(genuine).crossJoin(stable).select("used", "stable", "genuine", "min_sim", F.greatest(F.lit(0.005), F.col("low")).alias("min_margin"))


def loo_coherence(groups: DataFrame, width: int) -> DataFrame:
    """g, denominator, valid, missing, median, p10 of cosines between each vector and the sum of the others. groups: g, k, v (unit or null)."""
    total = groups.filter("v IS NOT NULL").groupBy("g").agg(summed(F.col("v"), width).alias("t"), F.count("*").alias("n"))
    j = groups.join(total, "g", "left").withColumn("o", F.zip_with("t", "v", lambda a, b: a - b.cast("double"))).withColumn("len", F.sqrt(dot(F.col("o"), F.col("o"))))
    score = F.when(F.col("v").isNotNull() & (F.col("n") >= 2) & (F.col("len") > 1e-12), clip(dot(F.col("v"), F.col("o")) / F.col("len")))
    d = kept(j.withColumn("s", score).select("g", "s"))
    n = d.groupBy("g").agg(F.count("*").alias("denominator"), F.count("s").alias("valid"), F.count(F.when(F.col("s").isNull(), 1)).alias("missing"))
    return n.join(group_quantiles(d, ["g"], "s", {"median": 0.5, "p10": 0.1}), "g", "left")
