"""Plans of file moves: targets by tier, conflicts, collisions, capacity and their summaries. Nothing is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors

#: Fixed names of conflicts.
CONFLICTS = ("already_correct", "capacity", "case_hazard", "changed_source", "cross_volume", "different_target", "missing", "name_collision", "path_length", "unreadable", "unsafe_path")
#: Fixed: UTF-16 units that a path stays below, and names that devices have.
LONGEST = 260
_DEVICE = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"
_BAD_END = r"[. ](/|$)"


def moves(scores: DataFrame, folders: dict[str, str]) -> DataFrame:
    """path, tier, src, dst: <character>/<folder of the tier>/<name>; a tier without a folder stays (dst null)."""
    folder = F.coalesce(*(F.when(F.col("tier") == t, F.lit(f)) for t, f in folders.items()), F.lit(None).cast("string"))
    parts = F.split("path", "/")
    character = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    return scores.select("path", "tier", F.col("path").alias("src"), F.when(folder.isNotNull(), F.concat_ws("/", F.nullif(character, F.lit("")), folder, F.element_at(parts, -1))).alias("dst"))


def move_summary(plan: DataFrame) -> DataFrame:
    """target (null: not moved), n, to_move, in_place."""
    target = F.element_at(F.split("dst", "/"), F.when(F.size(F.split("dst", "/")) > 1, -2).otherwise(-1))
    return plan.groupBy(target.alias("target")).agg(F.count("*").alias("n"), F.count(F.when(F.col("dst") != F.col("src"), 1)).alias("to_move"), F.count(F.when(F.col("dst") == F.col("src"), 1)).alias("in_place"))


def _units(path: Column) -> Column:
    return F.length(F.encode(path, "UTF-16LE")) / 2


def classify(items: DataFrame) -> DataFrame:
    """items with conflicts, sorted: what stands against each move by itself.

    items: k, src, dst, target, sha, size, src_sha (null: no such file), writable, same_volume, dst_sha (null: nothing there).
    """
    c = F.col
    gone, moved, there = c("src_sha").isNull(), c("src") != c("dst"), c("dst_sha").isNotNull()
    found = {
        "path_length": (_units(c("src")) >= LONGEST) | (_units(c("dst")) >= LONGEST),
        "unsafe_path": c("dst").rlike(_DEVICE) | c("dst").rlike(_BAD_END),
        "cross_volume": ~c("same_volume"),
        "missing": gone,
        "changed_source": ~gone & (c("src_sha") != c("sha")),
        "unreadable": ~gone & ~c("writable"),
        "already_correct": ~moved,
        "name_collision": moved & there,
        "different_target": moved & there & (c("dst_sha") != c("sha")),
    }
    return items.withColumn("conflicts", F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in found.items())))))


def resolve(classified: DataFrame, free: int) -> DataFrame:
    """classified with the conflicts that items have with each other: equal places but for case, several spellings, too little room.

    Collisions are counted by key and only the colliding keys come back, so that a common folder meets in no task.
    """
    low = {c: F.lower(c) for c in ("src", "dst")}
    hit = {c: classified.groupBy(v.alias(f"l_{c}")).agg(F.count("*").alias("n")).filter("n > 1").select(f"l_{c}", F.lit(True).alias(f"hit_{c}")) for c, v in low.items()}
    paths = classified.select("k", F.explode(F.concat(ancestors(F.col("dst")), F.array("dst"))).alias("p"))
    mixed = paths.groupBy(F.lower("p").alias("lp")).agg(F.min("p").alias("a"), F.max("p").alias("b")).filter("a <> b").select("lp")
    hazard = paths.select("k", F.lower("p").alias("lp")).join(mixed, "lp", "left_semi").select("k").distinct().withColumn("hazard", F.lit(True))
    need = classified.agg(F.coalesce(F.sum(F.when(F.size("conflicts") == 0, F.col("size"))), F.lit(0)).alias("needed"))
    d = classified.withColumns({f"l_{c}": v for c, v in low.items()}).join(hit["src"], "l_src", "left").join(hit["dst"], "l_dst", "left").join(hazard, "k", "left").crossJoin(F.broadcast(need))  # one row
    more = F.array_compact(F.array(F.when(F.col("hazard"), "case_hazard"), F.when(F.coalesce("hit_src", "hit_dst"), "name_collision"), F.when(F.col("needed") > free, "capacity")))
    return d.select(*(c for c in classified.columns if c != "conflicts"), F.array_sort(F.array_distinct(F.concat("conflicts", more))).alias("conflicts"), "needed")


def archive_summary(resolved: DataFrame) -> DataFrame:
    """kind, name, n: items of each target, of each conflict (none is left out), ready ones, and bytes that are needed."""
    zero = resolved.sparkSession.createDataFrame([(c,) for c in CONFLICTS], "name string")
    got = resolved.select(F.explode("conflicts").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    parts = resolved.groupBy("target").agg(F.count("*").alias("n")).select(F.lit("target").alias("kind"), F.col("target").alias("name"), "n")
    against = zero.join(got, "name", "left").select(F.lit("conflict").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    one = resolved.agg(F.count(F.when(F.size("conflicts") == 0, 1)).alias("ready"), F.coalesce(F.max("needed"), F.lit(0)).alias("bytes"))
    ends = one.select(F.explode(F.array(F.struct(F.lit("ready").alias("name"), F.col("ready").alias("n")), F.struct(F.lit("required_bytes").alias("name"), F.col("bytes").alias("n")))).alias("x")).select(F.lit("total").alias("kind"), "x.name", "x.n")
    return parts.union(against).union(ends)
