"""Operators that depend on an order: greedy selection, representative walls, whispers, seeded samples, overlapping boxes.

Where rows of one group decide about each other, the group is spread over rounds of joins or over its connected parts,
instead of being brought into one task. Only parts of a bounded number of links are tasks of their own.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, dot
from .blocks import matrix, products
from .grouping import summed
from .neardup import components
from .skew import importable, joined, kept, placed


def greedy_keep(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """k of the rows that a pass in order of k keeps, where a row near a kept one goes. pairs: a < b.

    A row without a nearer-to-the-front partner still undecided is kept and its partners go; each round does so for
    all such rows at once, which gives the same rows as the pass.
    """
    left, gone = kept(pairs.select("a", "b").distinct()), None
    while left.limit(1).count():
        roots = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = kept(left.join(roots, "a", "left_semi").select("b").distinct())
        gone = out if gone is None else gone.union(out)
        left = kept(left.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    rows = nodes.select("k")
    return rows if gone is None else rows.join(gone.select(F.col("b").alias("k")), "k", "left_anti")


def representative_wall(members: DataFrame, width: int, size: int = 12) -> DataFrame:
    """g, k, place of up to `size` members: medoid, the least coherent, then always the one farthest from all chosen.

    members: g, k, v (unit or null); ties go to the smaller k. A group with a member that has no vector, or no
    coherence with the rest, shows its first members by k.
    """
    total = members.filter("v IS NOT NULL").groupBy("g").agg(summed(F.col("v"), width).alias("t"))
    d = members.join(total, "g", "left").withColumn("o", F.zip_with("t", "v", lambda a, b: a - b.cast("double"))).withColumn("len", F.sqrt(dot(F.col("o"), F.col("o"))))
    d = kept(d.select("g", "k", "v", dot(F.col("v"), F.col("t")).alias("central"), F.when(F.col("len") > 1e-12, clip(dot(F.col("v"), F.col("o")) / F.col("len"))).alias("loo")))
    one = F.struct("k", "v")
    ends = d.groupBy("g").agg(F.bool_and(F.col("loo").isNotNull()).alias("good"), F.min_by(one, F.struct(-F.col("central"), F.col("k"))).alias("m"), F.min_by(one, F.struct("loo", "k")).alias("l"))
    plain = Window.partitionBy("g").orderBy("k")
    first = d.join(ends.filter("NOT good").select("g"), "g", "left_semi").withColumn("place", F.row_number().over(plain)).filter(F.col("place") <= size).select("g", "k", "place")
    state = d.join(ends.filter("good"), "g").select(
        "g", "k", "v", F.greatest(dot(F.col("v"), F.col("m.v")), dot(F.col("v"), F.col("l.v"))).alias("near"),
        F.when(F.col("k") == F.col("m.k"), 1).when(F.col("k") == F.col("l.k"), 2).alias("place"),
        F.when(F.col("m.k") == F.col("l.k"), 1).otherwise(2).alias("chosen"),
    )
    state = kept(state)
    for _ in range(size - 1):
        free = state.filter(F.col("place").isNull() & (F.col("chosen") < size))
        pick = free.groupBy("g").agg(F.min_by(one, F.struct("near", "k")).alias("p"))
        j = state.join(pick, "g", "left")
        state = kept(j.select("g", "k", "v", F.when(F.col("p").isNotNull(), F.greatest("near", dot(F.col("v"), F.col("p.v")))).otherwise(F.col("near")).alias("near"), F.when(F.col("k") == F.col("p.k"), F.col("chosen") + 1).otherwise(F.col("place")).alias("place"), (F.col("chosen") + F.col("p").isNotNull().cast("int")).alias("chosen")))
    return state.filter(F.col("place") <= size).select("g", "k", "place").union(first)


#: Links of a unit or a connected part, each counted from both ends, up to which it is one task; and steps in a link's weight,
#: whose sums are exact in any order.
PART_LINKS, STEPS = 2_000_000, 1 << 32
#: Nodes and bytes of their names up to which labels are sent to all workers; links that are packed or read at once.
SENT, BYTES, PACKED = 1 << 22, 64 << 20, 1 << 19


def _whispers(rounds: int):
    """Labels of one connected part, node by node."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        names, a = np.unique(edges["a"].to_numpy(), return_inverse=True)
        b, w = np.searchsorted(names, edges["b"].to_numpy()), edges["w"].to_numpy()
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        at = np.searchsorted(a, np.arange(len(names) + 1))
        label = np.arange(len(names))
        for _ in range(rounds):
            before = label.copy()
            for i in range(len(names)):
                near = label[b[at[i] : at[i + 1]]]
                of, place = np.unique(near, return_inverse=True)
                label[i] = of[np.bincount(place, w[at[i] : at[i + 1]]).argmax()]
            if np.array_equal(before, label):
                break
        return pd.DataFrame({"k": names, "label": names[label]})

    return run


def _packed(sent, bounds: np.ndarray):
    """Links (a, b, w) from both ends, as numbers of nodes, in one row for each unit of nodes and PACKED links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pd.Index(sent.value.to_pandas())

        def dealt(some: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b, w = (np.concatenate(x) for x in zip(*some, strict=True))
            a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
            unit = np.searchsorted(bounds, a, "right") - 1
            order = np.argsort(unit, kind="stable")
            a, b, w, unit = a[order], b[order], w[order], unit[order]
            cuts = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
            rows = [[x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (a, b, w)]
            return pa.RecordBatch.from_arrays([pa.array(unit[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in rows)], ["unit", "a", "b", "w"])

        some, n = [], 0
        for batch in batches:
            a, b = (names.get_indexer(batch[c].to_pandas()).astype(np.int32) for c in ("a", "b"))
            some.append((a, b, batch["w"].to_numpy()))
            n += len(a)
            if n >= PACKED:
                yield dealt(some)
                some, n = [], 0
        if n:
            yield dealt(some)

    return run


def _lined(spans: np.ndarray):
    """A unit's links node by node: rows of about PACKED links, each with the span of units that it is in, its first node and
    its nodes' numbers of links."""

    def run(t: pa.Table) -> pa.Table:
        a, b, w = (np.concatenate([np.frombuffer(x, kind) for c in t[name].chunks for x in (v.as_buffer() for v in c)]) for name, kind in (("a", np.int32), ("b", np.int32), ("w", np.int64)))
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        low = int(a[0])
        span = int(np.searchsorted(spans, low, "right")) - 1
        ends = np.cumsum(np.bincount(a - low))  # a node has a link, so a unit's numbers follow each other
        at, node, rows = 0, 0, []
        while node < len(ends):
            last = max(node + 1, int(np.searchsorted(ends, at + PACKED, "right")))
            to = int(ends[last - 1])
            counts = np.diff(ends[node:last], prepend=at).astype(np.int32)
            rows.append((span, int(spans[span]), int(spans[span + 1]), low + node, counts.tobytes(), b[at:to].tobytes(), w[at:to].tobytes()))
            at, node = to, last
        return pa.table(list(zip(*rows, strict=True)), schema=pa.schema([*((c, pa.int64()) for c in ("span", "low", "high", "first")), *((c, pa.binary()) for c in ("counts", "b", "w"))]))

    return run


def _sweep(sent):
    """node, label of those whose label changes as spans go through their nodes in order, each by what was sent: the labels
    before the round, the newest ones, the nodes that changed since (None: all are looked at), and whether the round begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new, moved, begins = sent.value
        span = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["span"] != span:
                    span, low, high = row["span"], row["low"], row["high"]
                    now, again = old.copy(), np.zeros(high - low, bool)
                    now[:low] = new[:low]
                counts, b, w = (np.frombuffer(row[c], kind) for c, kind in (("counts", np.int32), ("b", np.int32), ("w", np.int64)))
                ends = np.cumsum(counts)
                starts, first = ends - counts, row["first"]
                # what a node heard last changes with larger ones of the last round, and smaller ones of this; of its span's it knows
                if moved is None:
                    again[:] = True
                else:
                    told = moved[b]
                    told &= b > np.repeat(np.arange(first, first + len(counts), dtype=np.int32), counts) if begins else b < low
                    again[first - low : first - low + len(counts)] |= np.logical_or.reduceat(told, starts)
                nodes, labels = [], []
                for i, at, to in zip(range(first, first + len(counts)), starts.tolist(), ends.tolist(), strict=True):
                    if not again[i - low]:
                        now[i] = new[i]
                        continue
                    near = b[at:to]
                    label = now[near]
                    order = label.argsort()
                    label = label[order]
                    cuts = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1])
                    now[i] = label[cuts[np.add.reduceat(w[at:to][order], cuts).argmax()]]
                    if now[i] != new[i]:
                        nodes.append(i)
                        labels.append(now[i])
                        again[near[(near > i) & (near < high)] - low] = True
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(labels, pa.int32())], ["node", "label"])

    return run


def _swept(links: DataFrame, names: pa.Array, degrees: np.ndarray, rounds: int, unit_links: int) -> DataFrame:
    """k, label, the same as node by node. Nodes are dealt in their order into units of about `unit_links` links, which are
    sorted, and these into spans of units, a few for each core, whose tasks read them row by row and go through their
    nodes one after another. A pass takes all spans at once, each by the labels that the pass before found in smaller
    ones, and only nodes that hear something new are looked at again. Passes end where none changes anything: the first
    span needs no new label of another, the second only those of the first, and so on.
    """
    spark, n, kind = links.sparkSession, len(names), links.schema["a"].dataType
    before = np.cumsum(degrees) - degrees
    bounds = np.append(np.flatnonzero(np.diff(before // max(1, unit_links), prepend=-1)), n)
    many = 2 * spark.sparkContext.defaultParallelism
    step = -(-(len(bounds) - 1) // many)
    spans = np.append(bounds[:-1:step], n)
    named = spark.sparkContext.broadcast(names)
    packed = links.mapInArrow(_packed(named, bounds[:-1]), "unit long, a binary, b binary, w binary")
    lines = packed.groupBy("unit").applyInArrow(_lined(spans), "span long, low long, high long, first long, counts binary, b binary, w binary")
    if step > 1:  # by a hash, so more parts are asked for than there are spans, and most spans get their own
        lines = lines.repartition(8 * many, "span").sortWithinPartitions("span", "first")
    lines = kept(lines)
    old, moved = np.arange(n, dtype=np.int32), None
    for _ in range(rounds):
        new, begins = old.copy(), True
        while True:
            sent = spark.sparkContext.broadcast((old, new, moved, begins))
            found = lines.mapInArrow(_sweep(sent), "node int, label int").toArrow()
            sent.destroy()
            nodes, moved, begins = found["node"].to_numpy(), np.zeros(n, bool), False
            new[nodes], moved[nodes] = found["label"].to_numpy(), True
            if not (nodes < spans[-2]).any():  # nobody hears the last span's before the next round
                break
        moved = old != new
        old = new
        if not moved.any():
            break
    labels = spark.sparkContext.broadcast(old)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([named.value.take(x) for x in (batch["id"], pa.array(labels.value[batch["id"].to_numpy()]))], ["k", "label"])

    kind = kind.simpleString()
    return spark.range(n).mapInArrow(told, f"k {kind}, label {kind}")


def _whispered(both: DataFrame, rounds: int) -> DataFrame:
    """k, label of parts of any size, the same as node by node: in each round a node reads the new labels of smaller
    neighbours and the old ones of larger ones. Passes over all nodes, each with what the pass before found, end where none
    changes anything; what they end at is what the order gives, as the first node needs no new label, and so on."""
    state = kept(both.select(F.col("a").alias("k")).distinct().withColumns({"old": F.col("k"), "new": F.col("k")}))
    for _ in range(rounds):
        while True:
            told = joined(both, state.select(F.col("k").alias("b"), "old", "new"), ["b"])
            heard = told.select("a", "w", F.when(F.col("b") < F.col("a"), F.col("new")).otherwise(F.col("old")).alias("l"))
            loudest = heard.groupBy("a", "l").agg(F.sum("w").alias("w")).groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "l"))["l"].alias("heard"))
            after = kept(state.join(loudest, state["k"] == loudest["a"]).select("k", "old", F.col("heard").alias("new"), (F.col("heard") != F.col("new")).alias("changed")))
            state = after.drop("changed")
            if not after.filter("changed").limit(1).count():
                break
        settled = not state.filter("old <> new").limit(1).count()
        state = kept(state.select("k", F.col("new").alias("old"), "new"))
        if settled:
            break
    return state.select("k", F.col("new").alias("label"))


def _by_parts(points: DataFrame, links: DataFrame, rounds: int, part_links: int) -> DataFrame:
    """k, label. Connected parts don't touch each other's labels, so parts of up to `part_links` links are tasks of their
    own, and larger ones go through joins."""
    kind = dict(links.dtypes)["a"]
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    part = components(points, links).withColumnRenamed("k", "a")
    both = kept(both.join(part, "a"))
    sizes = both.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > part_links).select("component")
    large = kept(sizes)  # as many as parts of so many links fit
    got = both.join(F.broadcast(large), "component", "left_anti").groupBy("component").applyInPandas(_whispers(rounds), f"k {kind}, label {kind}")
    if large.limit(1).count():
        got = got.union(_whispered(kept(both.join(F.broadcast(large), "component", "left_semi").select("a", "b", "w")), rounds))
    return got


def whispers(points: DataFrame, links: DataFrame, least: int, rounds: int = 20, part_links: int = PART_LINKS, sent: int = SENT) -> DataFrame:
    """k, cluster of every point: label propagation in order of k, the heaviest label of the neighbours, the smallest of equals.

    links: a < b and weight w, read more than once. Where up to `sent` points have links, their labels are sent to all
    workers, and units of `part_links` links go through them side by side; more go by connected parts. Clusters of fewer
    than `least` points are null.
    """
    importable(points.sparkSession)
    w = F.round(F.col("w") * STEPS).cast("long").alias("w")
    links = links.select("a", "b", w)
    ends = links.groupBy("a").agg(F.count("*").alias("n")).union(links.groupBy("b").agg(F.count("*").alias("n")))
    nodes = kept(ends.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n")))
    few = nodes.orderBy("k").toArrow() if 0 < nodes.count() <= sent else None
    if few is not None and few["k"].nbytes <= BYTES:
        got = _swept(links, few["k"].combine_chunks(), few["n"].to_numpy(), rounds, part_links)
    else:
        got = _by_parts(points, links, rounds, part_links)
    got = kept(got)
    big = got.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("label")
    return points.select("k").join(got.join(big, "label", "left_semi"), "k", "left").select("k", F.col("label").alias("cluster"))


def seeded_sample(rows: DataFrame, seed: int, most: int = 100) -> DataFrame:
    """g, k of up to `most` distinct keys of each group, the ones that Python's generator draws from the sorted keys.

    A draw depends on a group's size alone, so sizes become places and only these are joined with the sorted keys.
    """

    @F.pandas_udf("array<bigint>")
    def drawn(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda n: random.Random(seed).sample(range(n), min(most, n)))

    d = rows.select("g", "k").distinct()
    places = d.groupBy("g").agg(F.count("*").alias("n")).select("g", F.explode(drawn("n")).alias("at"))
    return d.withColumn("at", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).cast("bigint")).join(places, ["g", "at"], "left_semi").select("g", "k")


def suppress(boxes: DataFrame, overlap: float = 0.5, least: int = 1) -> DataFrame:
    """image, x, y, w, h, score: the best boxes first, without those that overlap a kept one by more.

    boxes: image, width, height (of the image), x1, y1, x2, y2, score; an image has as many as its detector gives.
    Boxes of equal score go by their corners; a box under `least` pixels still suppresses others.
    """
    corners = ("x1", "y1", "x2", "y2")
    each = F.struct((-F.col("score")).alias("s"), *corners, "width", "height")
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))
    side = lambda a, b, lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))

    def hides(a, b):
        both = side(a, b, "x1", "x2") * side(a, b, "y1", "y2")
        return both / F.greatest(area(a) + area(b) - both, F.lit(1e-12)) > overlap

    g = boxes.groupBy("image").agg(F.array_sort(F.collect_list(each)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    picked = F.aggregate("all", none, lambda got, x: F.when(F.exists(got, lambda y: hides(y, x)), got).otherwise(F.concat(got, F.array(x))))
    b = g.select("image", F.explode(picked).alias("b"))
    x, y = (F.greatest(F.floor(f"b.{c}"), F.lit(0)).cast("int") for c in ("x1", "y1"))
    b = b.select("image", x.alias("x"), y.alias("y"), (F.least(F.ceil("b.x2"), F.col("b.width")) - x).cast("int").alias("w"), (F.least(F.ceil("b.y2"), F.col("b.height")) - y).cast("int").alias("h"), (-F.col("b.s")).alias("score"))
    return b.filter(F.least("w", "h") >= least).groupBy("image", "x", "y", "w", "h").agg(F.max("score").alias("score"))


def best_tags(tags: DataFrame, limits: dict[str, int], above: float = 0.35) -> DataFrame:
    """k, category, name, score, rank: the best names of each category over the floor."""
    w = Window.partitionBy("k", "category").orderBy(F.col("score").desc(), "name")
    most = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in limits.items()), F.lit(0))
    return tags.filter(F.col("score") > above).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("k", "category", "name", "score", "rank")


def cluster_report(members: DataFrame, width: int, top: int = 3) -> DataFrame:
    """cluster_id, size, confidence, representatives, margin of every cluster. members: k, cluster, prob, v (unit).

    Ids follow the clusters' smallest k; representatives are nearest to the centroid; the margin is the cosine of the
    nearest other centroid, null for a single cluster.
    """
    d = members.filter("cluster IS NOT NULL AND v IS NOT NULL")
    c = d.groupBy("cluster").agg(F.min("k").alias("least"), F.count("*").alias("size"), F.avg("prob").alias("confidence"), summed(F.col("v"), width).alias("t"))
    c = kept(c.withColumn("len", F.sqrt(dot(F.col("t"), F.col("t")))).select("cluster", "least", "size", "confidence", F.transform("t", lambda x: x / F.col("len")).alias("c")))
    near = d.join(c.select("cluster", "c"), "cluster").withColumn("s", dot(F.col("v"), F.col("c")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("s").desc(), "k"))
    shown = near.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("representatives"))
    kind = dict(c.dtypes)["cluster"]

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"cluster": x["cluster"][:0], "s": []})
        s = matrix(x["c"]) @ matrix(y["c"]).T
        s[x["cluster"].to_numpy()[:, None] == y["cluster"].to_numpy()[None, :]] = -2
        return pd.DataFrame({"cluster": x["cluster"], "s": s.max(1)})

    own = c.select("cluster", "c")
    margin = products(own, own, ("cluster", "cluster"), nearest, f"cluster {kind}, s double").filter("s > -2").groupBy("cluster").agg(clip(F.max("s")).alias("margin"))
    ids = placed(c, "least", name="cluster_id")
    return ids.join(shown, "cluster").join(margin, "cluster", "left").select("cluster_id", "cluster", "size", "confidence", "representatives", "margin")
