"""Near-duplicate links between bit strings, families, connected components and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, hex_int
from .metric import hamming_pairs, similar_pairs
from .ranking import family_id
from .skew import HOT_ROWS, joined, kept

#: Rows of one band above which they aren't paired with each other by it.
HOT_BAND = 4096


def banded_pairs(rows: DataFrame, key: str, bits: str, within: int, digits: int = 64, band: int | None = None) -> DataFrame:
    """a, b, distance of keys a < b whose hex strings differ in at most `within` bits.

    `within` differing bits leave at least one of `within` + 1 or more bands equal, so equal bands find every pair; the
    bands are as wide as that allows, unless `band` digits are asked for. Rows with a band that more than HOT_BAND of them
    share, as flat or padded strings do, are compared by cells of near strings instead (metric.py).
    """
    band = band or digits // (within + 1)
    bands = digits // band
    assert within < bands, "more differing bits than bands"
    d = rows.select(F.col(key).alias("k"), F.lpad(F.col(bits), digits, "0").alias("x"))
    # the digits are read once for a row, not once for a pair
    d = d.withColumn("h", F.array(*(hex_int(F.col("x"), i) for i in range(1, digits, 8))))
    d = d.select("k", "h", F.posexplode(F.array(*(F.substring("x", i * band + 1, band) for i in range(bands)))).alias("band", "v"))
    hot = kept(d.groupBy("band", "v").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BAND).select("band", "v"))
    crowd = None
    if hot.limit(1).count():
        # as many hot bands as rows in lots of HOT_BAND: a band is one of few values for most rows of its lot
        crowd = kept(d.join(hot, ["band", "v"], "left_semi").select("k").distinct())
        d = d.join(hot, ["band", "v"], "left_anti")
    a, b = (d.select("band", "v", F.col("k").alias(k), F.col("h").alias("h" + k)) for k in "ab")
    distance = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = a.join(b, ["band", "v"]).filter("a < b").select("a", "b", distance.alias("distance"))
    pairs = pairs.filter(F.col("distance") <= within)
    if crowd is not None:
        text = rows.select(F.col(key).alias("k"), F.lpad(F.col(bits), digits, "0").alias("v")).join(crowd, "k", "left_semi")
        pairs = pairs.union(hamming_pairs(text, within).select("a", "b", F.col("w").cast("int")))
    return pairs.distinct()


def theta_links(pairs: DataFrame, vectors: DataFrame, near: int = 6, far: int = 10, cosine: float = 0.96) -> DataFrame:
    """Links: at most `near` bits, or at most `far` bits and unit vectors at `cosine` or more. vectors: k, v."""
    j = pairs.join(vectors.select(F.col("k").alias("a"), F.col("v").alias("va")), "a", "left").join(vectors.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b", "left")
    return j.filter((F.col("distance") <= near) | ((F.col("distance") <= far) & (dot(F.col("va"), F.col("vb")) >= cosine))).select("a", "b")


def theta_families(rows: DataFrame, profile: str = "theta-v1", near: int = 6, far: int = 10, cosine: float = 0.96) -> DataFrame:
    """k, component, family_id of every row: the digest of the profile and its component's distinct contents.

    rows: k, sha256, hash (64 hex digits; null: a family of its own), v (a unit vector or null). Rows of one hash are
    folded before pairs are made, so copies cost no pairs; of a hash's rows each different vector may make a link.
    """
    hashed = kept(rows.filter("hash IS NOT NULL").select("k", "hash", "v"))
    met = joined if hashed.count() > HOT_ROWS else DataFrame.join
    folded = kept(hashed.groupBy("hash").agg(F.min("k").alias("k")))
    pairs = kept(banded_pairs(folded, "k", "hash", far))
    each = met(hashed.filter("v IS NOT NULL").select("hash", "v").distinct(), folded, ["hash"]).select("k", "v")
    close = pairs.filter(F.col("distance") <= near).select("a", "b")
    wide = theta_links(pairs.filter(F.col("distance") > near), each, near, far, cosine)
    copies = met(hashed.select("k", "hash"), folded.withColumnRenamed("k", "b"), ["hash"]).filter("k <> b").select(F.col("k").alias("a"), "b")
    part = components(rows, close.union(wide).union(copies).distinct())
    members = kept(part.join(rows.select("k", "sha256"), "k"))
    named = members.groupBy("component").agg(family_id(F.collect_set("sha256"), profile).alias("family_id"))
    return met(members, named, ["component"]).select("k", "component", "family_id")


def components(nodes: DataFrame, links: DataFrame, key: str = "k") -> DataFrame:
    """key, component (its smallest node): minimum labels with pointer jumping, each round kept in the shared folder.

    Only nodes with a link take part; joins on a node of very many links or on a large component's root salt these keys.
    """
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    many = both.count() > HOT_ROWS
    met = joined if many else DataFrame.join
    label = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("r")))
    while True:
        near = met(both, label.select(F.col("n").alias("b"), "r"), ["b"]).groupBy("a").agg(F.min("r").alias("m"))
        new = label.join(near, label["n"] == near["a"]).select("n", F.col("r").alias("old"), F.least("r", "m").alias("m"))
        new = kept(new) if many else new
        # all nodes of a root follow the least that one of them has met, and then that one's own root
        told = new.groupBy("old").agg(F.min("m").alias("r"))
        hooked = met(new.select("n", "old"), told, ["old"])
        hooked = kept(hooked) if many else hooked
        up = hooked.select(F.col("n").alias("r"), F.col("r").alias("rr"))
        step = kept(met(hooked, up, ["r"], "left").select("n", "old", F.coalesce("rr", "r").alias("r")))
        label = step.select("n", "r")
        if step.filter("old <> r").limit(1).count() == 0:
            break
    return nodes.select(key).distinct().join(label, F.col(key) == label["n"], "left").select(key, F.coalesce("r", key).alias("component"))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """k, cluster, core over unit vectors by cosine distance; border points join their smallest neighbouring core's cluster."""
    near = kept(similar_pairs(points, 1 - eps).select("a", "b"))
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = kept(points.join(both.groupBy("a").agg(F.count("*").alias("n")), F.col("k") == F.col("a"), "left").filter(F.coalesce("n", F.lit(0)) + 1 >= least).select("k"))
    inner = near.join(core.select(F.col("k").alias("a")), "a", "left_semi").join(core.select(F.col("k").alias("b")), "b", "left_semi")
    label = components(core, inner)
    border = both.join(label.select(F.col("k").alias("b"), "component"), "b").join(core.select(F.col("k").alias("a")), "a", "left_anti").groupBy("a").agg(F.min("component").alias("component"))
    named = label.withColumn("core", F.lit(True)).union(border.select("a", "component", F.lit(False)))
    return points.select("k").join(named, "k", "left").select("k", F.col("component").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
