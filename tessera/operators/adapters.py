"""Extension points: predictors, detectors and embedders of one's own, and the clusterers behind one switch.

An adapter is loaded once in a worker and sees Arrow batches; its outputs are held to its contract before they count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import density, neardup, ordered
from .metric import similar_pairs
from .skew import importable, kept


@dataclass(frozen=True)
class Predictor:
    """load() gives a function from a batch's payloads to an array with a row for each; low and high bound its values."""

    name: str
    revision: str
    preparation: str
    load: Callable[[], Callable[[list], np.ndarray]]
    low: float = float("-inf")
    high: float = float("inf")
    transform: Callable[[object], object] | None = None

    @property
    def lineage(self) -> str:
        return "|".join((self.name, self.revision, self.preparation))


def checked(values: np.ndarray, rows: int, low: float, high: float, name: str) -> np.ndarray:
    """The outputs, if there is one for each row, finite and in range."""
    values = np.asarray(values, float)
    if len(values) != rows or not np.isfinite(values).all() or (values < low).any() or (values > high).any():
        raise ValueError(f"{name}: outputs that break its contract")
    return values


def predicted(rows: DataFrame, p: Predictor, batch: int = 256) -> DataFrame:
    """k, value (null where the payload is), lineage of rows (k, payload)."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = p.load()
        for b in batches:
            out = np.full(len(b), np.nan)
            there = np.flatnonzero(b["payload"].notna().to_numpy())
            for at in range(0, len(there), batch):
                i = there[at : at + batch]
                items = [b["payload"].iloc[j] for j in i]
                out[i] = checked(predict([p.transform(x) for x in items] if p.transform else items), len(i), p.low, p.high, p.name)
            yield pd.DataFrame({"k": b["k"], "value": pd.Series(out).astype(object).where(~np.isnan(out), None), "lineage": p.lineage})

    return rows.select("k", "payload").mapInPandas(run, f"k {dict(rows.dtypes)['k']}, value double, lineage string")


def gaming_delta(plain: DataFrame, variants: list[DataFrame]) -> DataFrame:
    """k, gaming_delta: the largest drop of a score under the variants of its payload; null where one is missing."""
    j = plain.select("k", F.col("value").alias("_p"))
    for i, v in enumerate(variants):
        j = j.join(v.select("k", F.col("value").alias(f"_{i}")), "k", "left")
    drops = [F.col("_p") - F.col(f"_{i}") for i in range(len(variants))]
    known = F.lit(True)
    for x in drops:
        known = known & x.isNotNull()
    return j.select("k", F.when(known, F.greatest(*drops) if len(drops) > 1 else drops[0]).alias("gaming_delta"))


def detected(rows: DataFrame, load: Callable[[], Callable[[object], list[tuple[float, float, float, float, float]]]]) -> DataFrame:
    """image, x1, y1, x2, y2, score: as many boxes for a row (k, payload) as the detector finds; scores are in [0, 1]."""
    importable(rows.sparkSession)
    names = ["image", "x1", "y1", "x2", "y2", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for b in batches:
            b = b[b["payload"].notna()]
            out = [(k, *map(float, box)) for k, x in zip(b["k"], b["payload"], strict=True) for box in detect(x)]
            checked(np.array([r[5] for r in out]), len(out), 0.0, 1.0, "detector")
            yield pd.DataFrame(out, columns=names)

    return rows.select("k", "payload").mapInPandas(run, f"image {dict(rows.dtypes)['k']}, x1 double, y1 double, x2 double, y2 double, score double")


def embedded(crops: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], width: int) -> DataFrame:
    """k, v: the unit vector of each crop (k, payload); a vector of another width or without a length fails."""
    importable(crops.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for b in batches:
            m = np.asarray(embed(list(b["payload"])), float).reshape(len(b), -1)
            length = np.sqrt((m * m).sum(1))
            if m.shape[1] != width or not np.isfinite(m).all() or (length <= 1e-12).any():
                raise ValueError("vectors that break the embedder's contract")
            yield pd.DataFrame({"k": b["k"], "v": list(m / length[:, None])})

    return crops.select("k", "payload").mapInPandas(run, f"k {dict(crops.dtypes)['k']}, v array<double>")


def clustered(points: DataFrame, method: str, least: int = 5, eps: float = 0.3, links: float = 0.6) -> DataFrame:
    """k, cluster (null: noise) of unit vectors (k, v) by density_tree, dbscan or whispers."""
    if method == "density_tree":
        return density.density_tree(points.select(F.lit(0).alias("g"), "k", "v"), least).select("k", "cluster")
    if method == "dbscan":
        return neardup.dbscan(points, eps, least).select("k", "cluster")
    if method == "whispers":
        return ordered.whispers(points, kept(similar_pairs(points, links)), least)
    raise ValueError(f"no clusterer {method}")


def rediscovered(points: DataFrame, method: str, least_images: int = 10, **options) -> DataFrame:
    """cluster, members, images, seed: clusters of an unresolved pool (k, image, v); a seed has `least_images` distinct images."""
    j = points.join(clustered(points, method, **options).filter("cluster IS NOT NULL"), "k")
    return j.groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("image").alias("images")).withColumn("seed", F.col("images") >= least_images)
