"""Names and their aliases, inherited folders, deferred items, and the order in which clusters and items are reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors, clip


def owners(memory: DataFrame) -> DataFrame:
    """name, owner: each name and alias of the memory (name, aliases) and whose it is."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return memory.select(F.col("name").alias("owner"), F.explode(F.array_distinct(every)).alias("name")).select("name", "owner")


def alias_faults(memory: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """name, tag, fault of the decisions (name, tag, decision) that forbid their batch: a pair twice, one that isn't proposed, or a name's rejection of itself."""
    n = decisions.groupBy("name", "tag").agg(F.count("*").alias("n"), F.bool_or(F.col("decision") == "rejected").alias("no"))
    j = n.join(proposals.select("name", "tag", F.lit(True).alias("seen")).distinct(), ["name", "tag"], "left").join(owners(memory), "name", "left")
    fault = F.when(F.col("n") > 1, "twice").when(F.col("seen").isNull(), "unobserved").when(F.col("no") & (F.col("tag") == F.coalesce("owner", "name")), "own_name")
    return j.select("name", "tag", fault.alias("fault")).filter(F.col("fault").isNotNull())


def decide_aliases(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """name, aliases after a batch without faults: confirmed tags are added, rejected ones go, an unknown name begins a row."""
    d = decisions.join(owners(memory), "name", "left").withColumn("name", F.coalesce("owner", "name"))
    tags = lambda what: F.collect_set(F.when(F.col("decision") == what, F.col("tag")))
    g = d.groupBy("name").agg(tags("confirmed").alias("more"), tags("rejected").alias("less"))
    j = memory.select("name", "aliases").join(g, "name", "full")
    none = F.array().cast("array<string>")
    every = F.array_union(F.coalesce("aliases", none), F.coalesce("more", none))
    return j.select("name", F.array_sort(F.array_except(every, F.array_union(F.coalesce("less", none), F.array("name")))).alias("aliases"))


def merge_conflicts(decisions: DataFrame, moves: DataFrame) -> DataFrame:
    """name, tag on whose decision the names that moves (name, target) brings together disagree."""
    d = decisions.join(moves, "name", "left").select(F.coalesce("target", "name").alias("name"), "tag", "decision")
    return d.groupBy("name", "tag").agg(F.min("decision").alias("a"), F.max("decision").alias("b")).filter("a <> b").select("name", "tag")


def merge_names(memory: DataFrame, moves: DataFrame) -> DataFrame:
    """name, aliases, faces after merges and renames (moves: name, target): old names become aliases, faces are united. memory: name, aliases, faces."""
    d = memory.join(moves, "name", "left").withColumn("into", F.coalesce("target", "name"))
    g = d.groupBy("into").agg(F.flatten(F.collect_list("aliases")).alias("a"), F.collect_set("name").alias("n"), F.flatten(F.collect_list("faces")).alias("f"))
    aliases = F.array_except(F.array_union("a", "n"), F.array("into"))
    return g.select(F.col("into").alias("name"), F.array_sort(aliases).alias("aliases"), F.array_sort(F.array_distinct("f")).alias("faces"))


def inherited(members: DataFrame, folders: DataFrame) -> DataFrame:
    """folder, path of the members that a folder's selection takes in: those directly in it, and those below where it says descendants.

    members: path; folders: folder, descendants. Ancestors are exploded, so it is an equi-join and no prefix is compared.
    """
    up = members.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.explode(ancestors(F.col("path"))).alias("folder"))
    return up.join(folders, "folder").filter((F.col("parent") == F.col("folder")) | F.col("descendants")).select("folder", "path").distinct()


def deferred(images: DataFrame) -> DataFrame:
    """Images that are deferred or have a deferred subject. images: image, disposition, subjects (dispositions)."""
    return images.filter(F.coalesce(F.col("disposition") == "deferred", F.lit(False)) | F.coalesce(F.exists("subjects", lambda s: s == "deferred"), F.lit(False)))


def uncertainty(probability: Column, margin: Column, size: Column, detection: Column) -> Column:
    """0 to 1, high first in review: doubtful membership, thin margin, a cluster of one (or none), weak detection; unknown counts in part."""
    # least and greatest skip nulls, so these are asked for first
    one = lambda p, unknown: F.when(p.isNull(), unknown).otherwise(1 - clip(p, 0.0, 1.0))
    thin = F.when(margin.isNull(), 0.5).otherwise(1 - F.least(F.lit(1.0), F.abs(margin) / 0.5))
    alone = F.when(size.isNull() | (size <= 1), 1.0).otherwise(0.0)
    return one(probability, 0.55) * 0.4 + thin * 0.3 + alone * 0.2 + one(detection, 0.5) * 0.1


def effective_clusters(declared: DataFrame, faces: DataFrame) -> DataFrame:
    """cluster, size, confidence of declared clusters and of those that only faces name; a missing confidence is the members' mean probability."""
    g = faces.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("probability").alias("mean"))
    j = declared.select("cluster", F.col("size").alias("own"), "confidence", F.lit(True).alias("said")).join(g, "cluster", "full")
    return j.select("cluster", F.when(F.col("said"), F.col("own")).otherwise(F.col("n")).alias("size"), F.coalesce("confidence", "mean").alias("confidence"))
