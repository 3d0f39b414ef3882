"""Joins of evidence to what it claims to be about, and the predicates that decide what may be used or overwritten.

A binding that doesn't hold is told with its reason instead of being dropped, so that a caller can fail or exclude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hamming_hex
from .skew import joined, kept, placed

#: Faces of a label that are passed over at once.
HEAD = 512


def reason(*cases: tuple[str, Column], good: str = "bound") -> Column:
    """The first name whose condition holds; an unknown condition doesn't hold."""
    out = F.lit(good)
    for name, held in reversed(cases):
        out = F.when(F.coalesce(held, F.lit(False)), name).otherwise(out)
    return out


def bound_evidence(evidence: DataFrame, faces: DataFrame, provenance: DataFrame) -> DataFrame:
    """evidence (face, image, crop and more) with its status against faces (face, image) and provenance (face, crop)."""
    j = evidence.join(faces.select("face", F.col("image").alias("_image"), F.lit(True).alias("_known")), "face", "left").join(provenance.select("face", F.col("crop").alias("_crop")), "face", "left")
    status = reason(("unknown-face", F.col("_known").isNull()), ("image-mismatch", ~F.col("image").eqNullSafe(F.col("_image"))), ("crop-mismatch", ~F.col("crop").eqNullSafe(F.col("_crop"))))
    return j.select(*evidence.columns, status.alias("status"))


def bound_to(rows: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """rows with bound: whether all keys are those of a saved row."""
    marks = saved.select(*keys).distinct().withColumn("_b", F.lit(True))
    return rows.join(marks, keys, "left").select(*rows.columns, F.coalesce("_b", F.lit(False)).alias("bound"))


def exactly_one(wanted: DataFrame, members: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, status of every wanted key: its member if there is exactly one, else none or ambiguous."""
    n = members.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    j = wanted.select(key).distinct().join(n, key, "left")
    return j.select(key, F.when(F.col("_n") == 1, F.col(value)).alias(value), reason(("none", F.col("_n").isNull()), ("ambiguous", F.col("_n") > 1), good="one").alias("status"))


def supported_refs(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """k and the refs, in their order, that are committed relations: verified, human and assigned."""
    good = relations.filter((F.col("verified")) & (F.col("source") == "human") & (F.col("disposition") == "assigned")).select("ref").distinct().withColumn("_ok", F.lit(True))
    each = rows.select("k", F.posexplode_outer("refs").alias("_at", "ref")).join(good, "ref", "left")
    kept_refs = F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_at", "ref"))))
    return each.groupBy("k").agg(F.transform(kept_refs, lambda x: x["ref"]).alias("refs"))


def contained(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """group, members, missing, contained: whether each group's members are all among those of right."""
    marks = right.select(group, member).distinct().withColumn("_m", F.lit(1))
    j = left.select(group, member).distinct().join(marks, [group, member], "left")
    return j.groupBy(group).agg(F.count("*").alias("members"), F.count_if(F.col("_m").isNull()).alias("missing"), F.bool_and(F.col("_m").isNotNull()).alias("contained"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, only in b, and whether two projections hold the same rows, repeats counted."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right"))).select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("same"))


def selections(chosen: DataFrame, occurrences: DataFrame) -> DataFrame:
    """image, occurrence, path, status of each selection: unmatched is an error, an occurrence of several paths is excluded."""
    n = occurrences.groupBy("image", "occurrence").agg(F.min("path").alias("path"), F.count_distinct("path").alias("_n"))
    j = chosen.join(n, ["image", "occurrence"], "left")
    status = reason(("unmatched", F.col("_n").isNull()), ("excluded-ambiguous", F.col("_n") > 1), good="selected")
    return j.select("image", "occurrence", F.when(F.col("_n") == 1, F.col("path")).alias("path"), status.alias("status"))


def before_after(before: DataFrame, after: DataFrame, key: str, fixed: list[str], measured: str) -> DataFrame:
    """key, status, changed (fixed columns that differ), delta of what was measured."""
    b = before.select(key, *(F.col(c).alias(f"_b_{c}") for c in [*fixed, measured]), F.lit(True).alias("_b"))
    a = after.select(key, *(F.col(c).alias(f"_a_{c}") for c in [*fixed, measured]), F.lit(True).alias("_a"))
    j = b.join(a, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}")), F.lit(c)) for c in fixed)))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    status = reason(("added", F.col("_b").isNull()), ("removed", F.col("_a").isNull()), ("immutable-changed", F.size(changed) > 0), good="paired")
    return j.select(key, status.alias("status"), F.when(both, F.array_join(changed, "|")).otherwise("").alias("changed"), (F.col(f"_a_{measured}") - F.col(f"_b_{measured}")).alias("delta"))


def filmstrip(rows: DataFrame, most: int = 8) -> DataFrame:
    """k, size and the first other members of k's family, by place. rows: k, family, place; a family may be large."""
    w = Window.partitionBy("family").orderBy("place", "k")
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most + 1)
    heads = first.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "k"))), lambda x: x["k"]).alias("_h"))
    size = rows.groupBy("family").agg(F.count("*").alias("size"))
    j = rows.join(heads, "family").join(size, "family")
    return j.select("k", "size", F.slice(F.filter("_h", lambda x: x != F.col("k")), 1, most).alias("others"))


def cluster_members(members: DataFrame, manifest: DataFrame, records: DataFrame, subjects: DataFrame) -> DataFrame:
    """parent, member and status of each member of a frozen cluster before it is planned anew.

    members: parent, member, image, digest; manifest: member, image, digest; records: image, whole (cluster of the image);
    subjects: image, subject (= member), cluster. A membership in a cluster that isn't the parent is stale.
    """
    j = members.join(manifest.select("member", F.col("image").alias("_i"), F.col("digest").alias("_d")), "member", "left")
    j = j.join(records.select("image", "whole", F.lit(True).alias("_r")), "image", "left")
    many = subjects.groupBy("image").agg(F.count("*").alias("_s"))
    j = j.join(many, "image", "left").join(subjects.select("image", F.col("subject").alias("member"), F.col("cluster").alias("_c"), F.lit(True).alias("_t")), ["image", "member"], "left")
    held = F.when(F.col("_s").isNotNull(), F.col("_c")).otherwise(F.col("whole"))
    status = reason(
        ("cluster-manifest-binding", ~F.col("_i").eqNullSafe(F.col("image")) | ~F.col("_d").eqNullSafe(F.col("digest"))), ("cluster-content-missing", F.col("_r").isNull()),
        ("cluster-subject-missing", F.col("_s").isNotNull() & F.col("_t").isNull()), ("stale-cluster-membership", held != F.col("parent")), good="planned",
    )
    return j.select("parent", "member", status.alias("status"))


def overlaps(members: DataFrame, group: str, member: str) -> DataFrame:
    """One row: groups, members, members of their union, and whether no member is in two groups."""
    d = members.select(group, member)
    return d.agg(F.count_distinct(group).alias("parents"), F.count("*").alias("members"), F.count_distinct(member).alias("merged")).withColumn("disjoint", F.col("members") == F.col("merged"))


def contradictions(candidates: DataFrame, models: DataFrame, above: float = 0.35) -> DataFrame:
    """k, name, score, model: a row for each tied leader where the strongest evidence is over the floor and the model's name is none of them."""
    best = candidates.groupBy("k").agg(F.max("score").alias("score")).filter(F.col("score") > above)
    leaders = candidates.join(best, ["k", "score"]).select("k", "name", "score").distinct()
    agreed = leaders.join(models.select("k", F.col("model").alias("name")), ["k", "name"]).select("k").distinct()
    return leaders.join(models, "k").join(agreed, "k", "left_anti").select("k", "name", "score", "model")


def protected(source: Column, verified: Column, excluded: Column) -> Column:
    """Human decisions, accepted relations and explicit exclusions are never overwritten."""
    return F.coalesce(source == "human", F.lit(False)) | F.coalesce(verified, F.lit(False)) | F.coalesce(excluded, F.lit(False))


def archivable(source: Column, verified: Column, disposition: Column) -> Column:
    """Verified by a human and resolved."""
    return F.coalesce(verified & (source == "human") & disposition.isin("assigned", "unknown-foreign", "archived"), F.lit(False))


def private(nsfw: Column, tier: Column, limit: float = 0.65) -> Column:
    return F.coalesce(nsfw >= limit, F.lit(False)) | F.coalesce(tier == "route_nsfw", F.lit(False))


def output_faults(values: Column, kind: Column) -> Column:
    """What is wrong with a scorer's output (an array): finite, of its kind's shape and range; empty if nothing is.

    Kinds: probability (one value in [0, 1]), scalar (one value), pair (a mean and its sigma, not negative), vector.
    """
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first, second, n = F.get(values, F.lit(0)), F.get(values, F.lit(1)), F.size(values)
    return reason(
        ("missing", values.isNull()), ("nonfinite", ~finite), ("shape", F.when(kind == "pair", n != 2).when(kind == "vector", n == 0).otherwise(n != 1)),
        ("range", ((kind == "probability") & ~first.between(0, 1)) | ((kind == "pair") & (second < 0))), good="",
    )


def unresolved(subjects: DataFrame, included: DataFrame) -> DataFrame:
    """image, subject of what still needs a name: not verified, not excluded and pending, deferred or a hypothesis; and what is asked for by name."""
    open_ = subjects.filter(~F.coalesce("verified", F.lit(False)) & ~F.coalesce("excluded", F.lit(False)) & F.col("disposition").isin("pending", "deferred", "hypothesis"))
    asked = subjects.join(included.select("image", "subject").distinct(), ["image", "subject"], "left_semi")
    return open_.select("image", "subject").union(asked.select("image", "subject")).distinct()


def anchors(faces: DataFrame, least: float, cap: int, distance: int = 4, head: int = HEAD) -> DataFrame:
    """label, face, rank of the faces that a pass by falling score accepts: a score of `least`, hashes more than `distance`
    bits from each accepted one of the label, `cap` for each label. faces: label, face, score, hash (64 hex digits).

    Only a label's first `head` faces are passed over at once, against `cap` accepted ones at most, so no pairs are made.
    A label that is not full then goes on with its next faces that are far from all accepted ones; the first of these is
    accepted, so there are at most `cap` rounds, and one where most faces are far from each other.
    """
    good = faces.filter(F.col("score") >= least).select("label", "face", "score", "hash")
    left, done = kept(placed(good, F.desc("score"), "face", "hash", name="k").select("label", "face", "hash", "k")), None
    kind = left.select(F.array(F.struct("face", "hash")).alias("got")).schema["got"].dataType
    got = left.limit(0).select("label", F.lit(None).cast(kind).alias("got"))

    def near(got: Column, x: Column) -> Column:
        return F.exists(got, lambda y: F.coalesce(hamming_hex(y["hash"], x), F.lit(distance + 1)) <= distance)

    accept = lambda got, x: F.when((F.size(got) >= cap) | near(got, x["hash"]), got).otherwise(F.concat(got, F.array(F.struct(x["face"], x["hash"]))))
    while True:
        first = left.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("k"))).filter(F.col("n") <= head)
        first = first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "face", "hash"))).alias("first"))
        before = got.withColumnRenamed("label", "_label")
        # a label whose other faces are all near accepted ones is there without a head
        first = first.join(before, first["label"].eqNullSafe(before["_label"]), "full").select(F.coalesce("label", "_label").alias("label"), F.coalesce("first", F.array()).alias("first"), F.coalesce("got", F.array().cast(kind)).alias("got"))
        got = kept(first.select("label", F.aggregate("first", "got", accept).alias("got"), F.array_max(F.col("first")["k"]).alias("last"), (F.size("first") < head).alias("whole")))
        ends = F.col("whole") | (F.size("got") >= cap)
        ended = got.filter(ends).select("label", "got")
        done = ended if done is None else done.union(ended)
        got = got.filter(~ends).drop("whole")
        if not got.limit(1).count():
            break
        # the label null is one, whose faces meet what it accepted by a broadcast
        named = joined(left.filter("label IS NOT NULL"), got.filter("label IS NOT NULL"), ["label"])
        none = left.filter("label IS NULL").crossJoin(F.broadcast(got.filter("label IS NULL").drop("label")))
        rest = named.unionByName(none).filter((F.col("k") > F.col("last")) & ~near(F.col("got"), F.col("hash")))
        left, got = kept(rest.select("label", "face", "hash", "k")), got.drop("last")
    return done.select("label", F.posexplode("got").alias("at", "f")).select("label", "f.face", (F.col("at") + 1).alias("rank"))


def hash_ordered(rows: DataFrame, content: str, most: int) -> DataFrame:
    """The first `most` contents in order of their hash: a limit that is taken after the whole inventory, so it doesn't depend on listing order."""
    return rows.groupBy(content).agg(F.min("path").alias("path"), F.count("*").alias("paths")).orderBy(content).limit(most)


def path_prefix(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows by path, compared by code points."""
    return rows.orderBy("path").limit(most)
