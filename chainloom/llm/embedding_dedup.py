"""Operator 5, embedding near-dedup by dual traversal of cover trees.

Vectors of a label are put on the unit sphere, where cosine >= c means a distance of at
most t = sqrt(2 - 2c).  A cover tree is grown in Spark, level by level: a node of too many
vectors picks centers from a bounded sample of its own, apart by half the distance of the
level above, and its vectors go to their nearest center.  A node's ball is its center with
the distance of its farthest vector, so it covers whatever is below.  Pairs of nodes are
then followed from the roots down, by joins on the parent; a pair lives on only if its
centers are no farther apart than both radii and t allow.  Of pairs of leaves that are
left, one leaf's vectors that its partner's ball can reach visit that partner, where cover
trees of both (radii halving down to single vectors) are traversed in the same way.
Whatever the centers, no pair within t is pruned; the cosine of the pairs found is taken
exactly.

Equal vectors of a label are one point with a count; links go on as counts and as a
spanning forest, never pair by pair.  Points are told apart by 64 bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.components import connected_components
from chainloom.llm.shared import Scratch, local_components, ranges

#: Vectors in a leaf, children of a node, vectors that centers are picked from, levels.
LEAF, CHILDREN, PICKED, LEVELS = 1024, 32, 512, 24
#: Vectors of one node that are dealt to its centers in one task, partners of a leaf that a task holds, visitors of a leaf in one.
DEALT, PARTNERS, VISITORS = 8192, 64, 8192
#: Added to bounds against rounding.
SLACK = 1e-6
_CHUNK = 1 << 17


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).astype(np.float64).reshape(len(blobs), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from one another, within SLACK."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each vector from its partner, within SLACK."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, y)))


def _net(x: np.ndarray, radius: float, most: int, begin: list[int] | None = None) -> list[int]:
    """Greedy centers (their places in x), each farther than ``radius`` from those before it."""
    chosen = list(begin or [])
    near = _gaps(x, x[chosen]).min(axis=1) if chosen else np.full(len(x), np.inf)
    while len(chosen) < most:
        left = int(near.argmax())
        if near[left] <= radius:
            break
        chosen.append(left)
        near = np.minimum(near, _gaps(x, x[left]))
        near[left] = 0.0
    return chosen


class CoverTree:
    """Nested levels with halving radii over unit vectors; the last level holds the vectors themselves."""

    def __init__(self, x: np.ndarray, least: float):
        self.x = x
        chosen, radius = [0], float(_gaps(x, x[0]).max())
        levels = [chosen]
        while radius > least and len(levels[-1]) < len(x):
            radius /= 2
            chosen = _net(x, radius, len(x), chosen)
            levels.append(chosen)
        if len(levels[-1]) < len(x):
            levels.append(levels[-1] + [i for i in range(len(x)) if i not in set(levels[-1])])
        self.centers = [np.array(c) for c in levels]
        self.children: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = np.arange(len(levels[-1]))  # for each vector of the last level its node there
        at = self.centers[-1]
        radii = [np.zeros(len(at))]
        for up, down in zip(self.centers[-2::-1], self.centers[:0:-1]):
            gap = _gaps(x[down], x[up])
            gap[np.arange(len(up)), np.arange(len(up))] = -1.0  # a center stays under itself
            parent = gap.argmin(axis=1)
            order = np.argsort(parent, kind="stable")
            starts = np.searchsorted(parent[order], np.arange(len(up) + 1))
            self.children.append((order, starts[:-1], np.diff(starts)))
            below = parent[below]
            r = np.zeros(len(up))
            np.maximum.at(r, below, _between(x[at], x[up[below]]))
            radii.append(r)
        self.children.reverse()
        self.radii = radii[::-1]

    def depth(self) -> int:
        return len(self.centers) - 1


def tree_links(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the two trees' vectors with cosine >= ``cosine``; of one tree, i < j."""
    t = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    i = j = np.zeros(1, dtype=np.int64)
    la = lb = 0
    while True:
        if len(i) > max(_CHUNK, 0.2 * len(a.x) * len(b.x)):  # nothing left to prune: all pairs by matrix product
            rough = a.x @ b.x.T >= cosine - 1e-6
            if same:
                rough = np.triu(rough, 1)
            x, y = np.nonzero(rough)
            break
        keep = np.zeros(len(i), dtype=bool)
        for s in range(0, len(i), _CHUNK):
            p, q = i[s : s + _CHUNK], j[s : s + _CHUNK]
            keep[s : s + _CHUNK] = _between(a.x[a.centers[la][p]], b.x[b.centers[lb][q]]) <= a.radii[la][p] + b.radii[lb][q] + t
        i, j = i[keep], j[keep]
        if la == a.depth() and lb == b.depth():
            x, y = a.centers[la][i], b.centers[lb][j]
            if same:
                x, y = np.minimum(x, y), np.maximum(x, y)
                x, y = x[x < y], y[x < y]
            break
        twin = i == j  # of one tree: one node with itself
        if la < a.depth():
            order, starts, counts = a.children[la]
            n = counts[i]
            i, j, twin, la = order[ranges(starts[i], n)], np.repeat(j, n), np.repeat(twin, n), la + 1
        if lb < b.depth():
            order, starts, counts = b.children[lb]
            n = counts[j]
            j, i, twin, lb = order[ranges(starts[j], n)], np.repeat(i, n), np.repeat(twin, n), lb + 1
        if same:
            once = ~twin | (i <= j)
            i, j = i[once], j[once]
    out = np.zeros(len(x), dtype=bool)
    for s in range(0, len(x), _CHUNK):
        u, v = raw_a[x[s : s + _CHUNK]], raw_b[y[s : s + _CHUNK]]
        u, v = u / np.abs(u).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
        out[s : s + _CHUNK] = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))) >= cosine
    return x[out], y[out]


def _grow(points: DataFrame, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pid, n, vec, leaf) of all points, and the tree: (parent, node, center, radius).

    A leaf has LEAF vectors at most, or is part of a node that can't be split.  Roots are
    named by label and length; a root's ball is the whole sphere.
    """
    node = points.select("pid", "n", "vec", F.col("root").alias("node"), F.lit(2.0).alias("apart"))
    ended, balls = [], []
    for level in range(LEVELS + 1):
        sizes = node.groupBy("node").agg(F.count("*").alias("size"), F.max("apart").alias("apart")).where((F.col("size") > LEAF) & (F.col("apart") > 0))
        sizes = scratch.write(sizes if level < LEVELS else sizes.where("false"))
        ended.append(node.join(sizes, "node", "left_anti").select("pid", "n", "vec", "node"))
        if sizes.isEmpty():
            break
        sampled = node.drop("apart").join(sizes, "node").where(F.pmod(F.xxhash64("pid", F.lit(level)), F.col("size")) < PICKED)

        def pick(table: pa.Table) -> pa.Table:
            table = table.sort_by("pid")
            x = _unit(_matrix(table["vec"].to_pylist(), kind))
            apart, size = table["apart"][0].as_py() / 2, table["size"][0].as_py()
            most = int(min(CHILDREN, max(2, -(-2 * size // LEAF))))
            while len(chosen := _net(x, apart, most)) < 2 and apart > 1e-3:
                apart /= 2
            parent, k = table["node"][0].as_py(), len(chosen)
            return pa.table(
                {
                    "parent": pa.array([parent] * k, pa.int64()),
                    "node": pa.array([_child(parent, i) for i in range(k)], pa.int64()),
                    "apart": pa.array([apart if k > 1 else 0.0] * k),
                    "parts": pa.array([-(-size // DEALT)] * k, pa.int64()),
                    "center": pa.array(x[chosen].tolist(), pa.list_(pa.float64())),
                }
            )

        picked = scratch.write(sampled.groupBy("node").applyInArrow(pick, "parent bigint, node bigint, apart double, parts bigint, center array<double>"))
        part = F.pmod(F.xxhash64("pid"), F.ceil(F.col("size") / DEALT))
        large = node.select("pid", "n", "vec", "node").join(sizes.select("node", "size"), "node").withColumn("part", part).drop("size")
        held = picked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

        def assign(some: pa.Table, centers: pa.Table) -> pa.Table:
            x = _unit(_matrix(some["vec"].to_pylist(), kind))
            gap = _gaps(x, np.array(centers["center"].to_pylist(), dtype=np.float64))
            which = gap.argmin(axis=1)
            every = np.arange(len(x))
            return pa.table(
                {
                    "pid": some["pid"],
                    "n": some["n"],
                    "vec": some["vec"],
                    "node": pa.array(np.array(centers["node"].to_pylist(), dtype=np.int64)[which]),
                    "apart": pa.array(np.array(centers["apart"].to_pylist(), dtype=np.float64)[which]),
                    "gap": pa.array(gap[every, which]),
                }
            )

        dealt = large.groupBy("node", "part").cogroup(held.groupBy("parent", "part")).applyInArrow(assign, "pid bigint, n bigint, vec binary, node bigint, apart double, gap double")
        dealt = scratch.write(dealt)
        radius = dealt.groupBy("node").agg((F.max("gap") + SLACK).alias("radius"))
        balls.append(picked.select("parent", "node", "center").join(radius, "node").select("parent", "node", "center", "radius"))
        node = dealt.select("pid", "n", "vec", "node", "apart")
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    # what can't be split any more is cut into parts, each a child of it with its ball
    sizes = scratch.write(every.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > LEAF))
    part = F.xxhash64("node", F.pmod(F.xxhash64("pid"), F.ceil(2 * F.col("size") / LEAF)))
    leaves = scratch.write(every.join(sizes, "node", "left").select("pid", "n", "vec", "node", F.when(F.col("size").isNull(), F.col("node")).otherwise(part).alias("leaf")))
    if not balls:
        tree = node.sparkSession.createDataFrame([], "parent bigint, node bigint, center array<double>, radius double")
    else:
        tree = balls[0]
        for more in balls[1:]:
            tree = tree.unionByName(more)
    tree = scratch.write(tree)
    cut = leaves.where("leaf != node").select(F.col("node").alias("parent"), F.col("leaf").alias("node")).distinct()
    whole = F.array(F.lit(0.0)), F.lit(2.0)  # of a root that is cut itself: no center, and all are near
    cut = cut.join(tree.select(F.col("node").alias("parent"), "center", "radius"), "parent", "left").select("parent", "node", F.coalesce("center", whole[0]).alias("center"), F.coalesce("radius", whole[1]).alias("radius"))
    return leaves.select("pid", "n", "vec", "leaf"), scratch.write(tree.unionByName(cut))


def _child(parent: int, k: int) -> int:
    """A number for the k-th child of a node."""
    x = np.array([(parent * 0x9E3779B97F4A7C15 + (k + 1) * 0xD6E8FEB86659FD93) % (1 << 64)], dtype=np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return int(x.view(np.int64)[0])


def _near_leaves(leaves: DataFrame, tree: DataFrame, roots: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of leaves, a <= b, whose balls leave room for a link; every leaf with itself."""
    inner = tree.select(F.col("parent").alias("node"), F.lit(True).alias("more")).distinct()
    # a step down: from a node to its children, from a leaf to itself
    down = tree.join(inner, "node", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    still = down.where("not more").select(F.col("node").alias("parent"), "node", "center", "radius", "more")
    top = roots.join(inner.select("node"), "node", "left_anti").select(F.col("node").alias("parent"), "node", F.array(F.lit(0.0)).alias("center"), F.lit(2.0).alias("radius"), F.lit(False).alias("more"))
    down = scratch.write(down.select("parent", "node", "center", "radius", "more").unionByName(still).unionByName(top))
    side = lambda s: down.select(F.col("parent").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "center", "radius", "more")])
    # the centers' distance; a root that is a leaf has no center, and meets itself only
    gap = F.sqrt(F.aggregate(F.zip_with("a_center", "b_center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))
    near = (F.size("a_center") < 2) | (gap <= F.col("a_radius") + F.col("b_radius") + t)
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for _ in range(LEVELS + 2):
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node"))) & near)
        pairs = scratch.write(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), (F.col("a_more") | F.col("b_more")).alias("more")))
        if pairs.where("more").isEmpty():
            break
    else:
        raise RuntimeError("the cover tree is deeper than its levels")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of one label (not null) and one length link if their cosine in double precision
    is at least ``cosine``.  Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing: n_links 0, component themselves.  n_links counts other
    rows; repeated rows count as rows of their own, and so do different vectors of one
    vec_id.  An empty table gives an empty table; other columns don't matter.
    """
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    scratch = Scratch(vectors.sparkSession, "vectors")

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        out = []
        at, ends = column.offsets.to_numpy(), column.is_valid().to_pylist()
        every = column.values.to_numpy(zero_copy_only=False).astype(kind)  # null components: not a number
        for a, b, there in zip(at[:-1], at[1:], ends):
            v = every[a:b]
            out.append(v.tobytes() if there and b > a and np.isfinite(v).all() and v.any() else None)
        return pa.array(out, pa.binary())

    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), packed(F.col(embedding)).alias("vec"))
    rows = rows.withColumn("vec", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("vec")))
    rows = scratch.write(rows.select("vec_id", "vec", F.xxhash64("label", F.length("vec")).alias("root"), F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")).alias("pid")))
    points = scratch.write(rows.where("vec is not null").groupBy("pid", "root", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))

    leaves, tree = _grow(points, kind, scratch)
    t = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    pairs = _near_leaves(leaves, tree, points.select(F.col("root").alias("node")).distinct(), t, scratch)

    # vectors of leaf b visit leaf a if a's ball, with t around it, reaches them
    partners = pairs.where("a != b").join(tree.select(F.col("node").alias("a"), "center", "radius"), "a")
    counts = scratch.write(partners.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")))
    calls = partners.join(counts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).select("b", "part", "a", "center", "radius")
    hosts = leaves.join(counts.withColumnRenamed("b", "leaf"), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def visit(some: pa.Table, calls: pa.Table) -> pa.Table:
        x = _unit(_matrix(some["vec"].to_pylist(), kind)) if some.num_rows else np.zeros((0, 1))
        to, who = [], []
        for a, center, radius in zip(*(calls[c].to_pylist() for c in ("a", "center", "radius"))):
            c = np.array(center)
            near = np.flatnonzero(_gaps(x, c) <= radius + t) if len(c) == x.shape[1] else np.arange(len(x))
            to.append(np.full(len(near), a, dtype=np.int64))
            who.append(near)
        at = pa.array(np.concatenate(who)) if who else pa.array([], pa.int64())
        return pa.table({"leaf": pa.array(np.concatenate(to) if to else [], pa.int64()), **{c: some[c].take(at) for c in ("pid", "n", "vec")}})

    visits = scratch.write(hosts.select("leaf", "part", "pid", "n", "vec").groupBy("leaf", "part").cogroup(calls.groupBy("b", "part")).applyInArrow(visit, "leaf bigint, pid bigint, n bigint, vec binary"))
    crowds = scratch.write(visits.groupBy("leaf").agg(F.ceil(F.count("*") / VISITORS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    at_home = leaves.join(crowds, "leaf", "left").select("leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.lit(True).alias("own"), "pid", "n", "vec")
    guests = visits.join(crowds, "leaf").select("leaf", F.pmod(F.xxhash64("pid"), F.col("parts")).alias("part"), F.lit(False).alias("own"), "pid", "n", "vec")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "descending"), ("pid", "ascending")])
        pid, n = (np.array(table[c].to_pylist(), dtype=np.int64) for c in ("pid", "n"))
        raw = _matrix(table["vec"].to_pylist(), kind)
        x = _unit(raw)
        mine = int(sum(table["own"].to_pylist()))
        home = CoverTree(x[:mine], t / 4)
        links, i, j = np.zeros(len(pid), dtype=np.int64), [], []
        for begin in [0] * (table["part"][0].as_py() == 0) + list(range(mine, len(pid), LEAF)):
            end = min(begin + LEAF, len(pid)) if begin else mine
            other = CoverTree(x[begin:end], t / 4) if begin else home
            u, v = tree_links(home, other, raw[:mine], raw[begin:end], cosine, not begin)
            v = v + begin
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            i.append(u)
            j.append(v)
        if not i:
            i = j = [np.zeros(0, dtype=np.int64)]
        low = local_components(len(pid), np.concatenate(i), np.concatenate(j))
        met = np.flatnonzero(links)
        return pa.table({"pid": pa.array(pid[met]), "links": pa.array(links[met]), "low": pa.array(pid[low[met]])})

    found = scratch.write(at_home.unionByName(guests).groupBy("leaf", "part").applyInArrow(compare, "pid bigint, links bigint, low bigint"))
    groups = connected_components(found, "pid", "low")
    links = found.groupBy("pid").agg(F.sum("links").alias("links"))
    facts = points.select("pid", "rep", "n").join(links, "pid", "left").join(groups.select(F.col("node").alias("pid"), "component"), "pid", "left")
    facts = scratch.write(facts.select("pid", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "pid").alias("grp")))
    least = scratch.write(facts.groupBy("grp").agg(F.min("rep").alias("component_id")))
    facts = scratch.write(facts.join(least, "grp").select("pid", "n_links", "component_id"))
    linked = rows.join(facts, "pid").select("vec_id", "n_links", "component_id")
    alone = rows.where("pid is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
