"""Graph of nearest neighbours, and a two-dimensional map of all rows from it.

Random projection trees (Dasgupta and Freund, 2008) put near rows into common leaves, neighbour descent (Dong, Charikar and
Li, 2011) mends the lists, and the map is the spectral layout of the graph (Belkin and Niyogi, 2003). Row ids are unique
and not null; rows without a vector are left out. Equal vectors, however many, are dealt to leaves by the hash of their
ids, so a leaf never holds more than ``leaf`` rows. An empty table gives an empty graph and an empty map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions.fixed_values import DEFAULT_SEED
from topicweave.operators.bounded import join_lookup
from topicweave.session import small_batches, staged

MAX_LEVELS = 60  # a node number has a bit per level
SLICE_BYTES = 4 << 20  # vectors that a task turns into one matrix, and edges that it gives at once
BATCH_ROWS = 256  # meetings that travel to a task at once

EDGES = "src long, dst long, dist double"


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _projections(rows: DataFrame, dim: int, trees: int, levels: int, seed: int) -> DataFrame:
    """One row per row and tree: its place along one random direction for every level of the tree."""
    directions = np.random.default_rng(seed).normal(size=(dim, trees * levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places = (_matrix(batch.column("vec")) @ directions).reshape(-1, levels)
            offsets = pa.array(np.arange(0, places.size + 1, levels, dtype=np.int32))
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, trees)),
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))),
                    pa.ListArray.from_arrays(offsets, pa.array(places.ravel())),
                ],
                ["id", "tree", "places"],
            )

    return rows.mapInArrow(run, "id long, tree int, places array<double>")


def tree_leaves(rows: DataFrame, dim: int, trees: int, leaf: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """(id, tree, node): the leaf of every row in every tree; no leaf has more than ``leaf`` rows.

    All trees grow together, a level per pass. A pass takes the count and the median (a mergeable sketch) of every node and
    sends its rows left and right of it; rows on the median go by a bit of their hash. The rows of a node never meet.
    """
    n = rows.count()
    levels = min(MAX_LEVELS, max(1, 2 * int(np.ceil(np.log2(max(n / leaf, 1)))) + 8))
    state = _projections(rows, dim, trees, levels, seed).withColumn("node", F.lit(1).cast("long"))
    state = staged(state, "tree-level")
    for level in range(MAX_LEVELS):
        place = F.element_at("places", level % levels + 1)
        nodes = state.groupBy("tree", "node").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx(place, 0.5, 200).alias("cut")
        )
        full = staged(nodes.where(F.col("n") > leaf).drop("n"), "tree-nodes")
        if full.isEmpty():
            return state.select("id", "tree", "node")
        bit = F.shiftrightunsigned(F.xxhash64("id", "tree"), level).bitwiseAND(F.lit(1))
        side = F.when(place > F.col("cut"), 1).when(place < F.col("cut"), 0).otherwise(bit)
        child = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)
        moved = join_lookup(state, full, ["tree", "node"], "left", spread=F.col("id"))
        state = staged(moved.select("id", "tree", "places", child.alias("node")), "tree-level")
    raise ValueError("rows that cannot be told apart: are the ids unique?")


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """The ``k`` nearest other rows of each row of a bounded set: row, neighbour, squared distance."""
    norms = (x * x).sum(axis=1)
    d = norms[:, None] + norms - 2.0 * (x @ x.T)
    d[ids[:, None] == ids] = np.inf
    k = min(k, len(ids) - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    at = np.repeat(np.arange(len(ids)), k)
    to = near.ravel()
    real = np.isfinite(d[at, to])
    at, to = at[real], to[real]
    gap = x[at] - x[to]  # anew for the chosen pairs: no cancellation
    return ids[at], ids[to], (gap * gap).sum(axis=1)


def _edge_batch(src, dst, dist) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(dist)], ["src", "dst", "dist"])


def _leaf_edges(leaves: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("vec").combine_chunks())
        order = np.argsort(ids)
        return pa.Table.from_batches([_edge_batch(*_nearest(ids[order], x[order], k))])

    return leaves.join(rows, "id").groupBy("tree", "node").applyInArrow(run, EDGES)


def _best(edges: DataFrame, k: int, by: str = "src") -> DataFrame:
    """The ``k`` nearest of each row, every pair once. Ties go by the hash of the pair, so no row attracts all of them."""
    pairs = edges.repartition(F.col(by)).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    along = Window.partitionBy(by).orderBy("dist", F.xxhash64("src", "dst"), "dst", "src")
    return pairs.withColumn("_r", F.row_number().over(along)).where(F.col("_r") <= k).drop("_r")


def _descend(edges: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Better lists: all rows that are neighbours of a common row, in either direction, are compared with each other.

    A meeting has at most 2 ``k`` + 1 rows, and each of them takes home its ``k`` nearest of it.
    """
    towards = _best(edges, k, "dst").select(F.col("dst").alias("at"), F.col("src").alias("id"))
    away = edges.select(F.col("src").alias("at"), F.col("dst").alias("id"))
    itself = rows.select(F.col("id").alias("at"), "id")
    guests = away.unionByName(towards).unionByName(itself).distinct()
    one = F.struct(F.xxhash64("at", "id").alias("order"), "id", "vec")
    meetings = guests.join(rows, "id").groupBy("at").agg(F.array_sort(F.collect_list(one)).alias("guests"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(batches, k)

    return _best(edges.unionByName(meetings.select("guests").mapInArrow(run, EDGES)), k)


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Edges among the guests of each meeting, from slices of about ``SLICE_BYTES`` of vectors or edges, whichever is more."""
    for batch in batches:
        edges = 24 * k * len(batch.column("guests").flatten())  # bytes of what comes out, at most
        step = max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes, edges))
        for begin in range(0, batch.num_rows, step):
            lists = batch.slice(begin, step).column("guests")
            each = lists.flatten()
            ids, x = each.field("id").to_numpy(), _matrix(each.field("vec"))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found = [_nearest(ids[a:b], x[a:b], k) for a, b in zip(ends[:-1], ends[1:])]
            yield _edge_batch(*(np.concatenate(c) for c in zip(*found)))


def neighbour_graph(
    df: DataFrame, features: str, row_id: str, k: int = 15, trees: int = 4, leaf: int = 256, rounds: int = 2,
    pool: int = 2, seed: int = DEFAULT_SEED, min_change: float = 0.002,
) -> DataFrame:
    """(src, dst, dist): the ``k`` nearest rows of every row, with squared distances; fewer only in a smaller table.

    Approximate; ``trees``, ``leaf``, ``rounds`` and ``pool`` trade time for recall: lists of ``pool`` times ``k`` rows are
    kept until the end. Descent ends early once a round replaces less than ``min_change`` of the edges.
    """
    rows = df.where(F.col(features).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), F.col(features).cast("array<double>").alias("vec")
    )
    rows = staged(rows, "vectors")
    dim = rows.agg(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return df.sparkSession.createDataFrame([], EDGES)
    wide = pool * k
    edges = staged(_best(_leaf_edges(tree_leaves(rows, dim, trees, leaf, seed), rows, wide), wide), "edges")
    for _ in range(rounds):
        with small_batches(df.sparkSession, BATCH_ROWS):
            better = staged(_descend(edges, rows, wide), "edges")
        new, total = better.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").count(), better.count()
        edges = better
        if new <= min_change * total:
            break
    return _best(edges, k)


def recall(graph: DataFrame, df: DataFrame, features: str, row_id: str, queries: Column, k: int = 15) -> float:
    """Share of the true ``k`` nearest rows of the query rows that the graph lists; distances as near count as well.

    Exact by blocks: the queries are collected in blocks of 1024, each compared with all rows in one pass that keeps the
    ``k`` smallest distances per query and task.
    """
    vec = F.col(features).cast("array<double>")
    rows = df.where(F.col(features).isNotNull()).select(F.col(row_id).cast("long").alias("id"), vec.alias("vec"))
    asked = staged(rows.join(df.where(queries).select(F.col(row_id).cast("long").alias("id")), "id", "left_semi"), "asked")
    reach = graph.groupBy("src").agg(F.sort_array(F.collect_list("dist")).alias("listed"))
    blocks = max(1, -(-asked.count() // 1024))
    hits = total = 0
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if part.num_rows == 0:
            continue
        ids, q = part.column("id").to_numpy(), _matrix(part.column("vec").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = _matrix(batch.column("vec")), batch.column("id").to_numpy()
                d = np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2.0 * (q @ x.T), 0.0)
                d[ids[:, None] == own] = np.inf
                d = np.sort(d, axis=1)[:, :k]
                at, col = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(d[at, col])], ["src", "d"])

        near = rows.mapInArrow(run, "src long, d double").groupBy("src").agg(F.sort_array(F.collect_list("d")).alias("d"))
        true = near.select("src", F.slice("d", 1, k).alias("d")).withColumn("far", F.element_at("d", -1))
        both = true.join(reach, "src", "left")
        good = F.size(F.filter(F.coalesce("listed", F.array().cast("array<double>")), lambda v: v <= F.col("far") * (1 + 1e-9) + 1e-12))
        got, want = both.agg(F.sum(good), F.sum(F.size("d"))).first()
        hits, total = hits + (got or 0), total + (want or 0)
    return hits / total if total else 1.0


def _weights(edges: DataFrame) -> DataFrame:
    """Symmetric weights (id, to, w): nearness relative to the reach of a row's list, joined as 1 - (1 - a)(1 - b)."""
    reach = F.max("dist").over(Window.partitionBy("src"))
    near = F.when(reach > 0, F.exp(-F.col("dist") / reach)).otherwise(F.lit(1.0))
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), near.alias("w"))
    # at most two rows a pair
    w = F.when(F.count("w") > 1, F.max("w") + F.min("w") - F.max("w") * F.min("w")).otherwise(F.max("w"))
    once = pair.groupBy("a", "b").agg(w.alias("w"))
    there = once.select(F.col("a").alias("id"), F.col("b").alias("to"), "w")
    return there.unionByName(once.select(F.col("b").alias("id"), F.col("a").alias("to"), "w"))


def spectral_layout(edges: DataFrame, start: DataFrame, steps: int = 30, tol: float = 1e-3) -> DataFrame:
    """(id, x, y): the two leading eigenvectors of the graph's normalised weights beside the trivial one.

    Power iteration on (I + D^-1/2 W D^-1/2) / 2 from ``start`` (id, x, y): a step is a join of the edges with the values
    at their ends and a sum per row; the driver sees five sums, by which the vectors are kept orthogonal and of unit
    length. It ends when both eigenvalues move by less than ``tol``, after ``steps`` at the latest. Rows of ``start``
    without edges stay at the origin.
    """
    spark = edges.sparkSession
    weights = staged(_weights(edges), "weights")
    degree = weights.groupBy("id").agg(F.sum("w").alias("deg"))
    state = staged(start.select("id", "x", "y").join(degree, "id", "left").withColumn("root", F.sqrt(F.coalesce("deg", F.lit(0.0)))), "layout")
    root = state.select("id", "root")
    here, there = root.withColumnRenamed("root", "r1"), root.select(F.col("id").alias("to"), F.col("root").alias("r2"))
    links = weights.join(here, "id").join(there, "to").select("id", "to", (F.col("w") / (F.col("r1") * F.col("r2"))).alias("m"))
    links = staged(links, "links")
    size = state.agg(F.sum(F.col("root") * F.col("root"))).first()[0] or 0.0
    state, last, lead = state.drop("deg"), (0.0, 0.0), (0.0, 0.0)
    for step in range(steps + 1):
        # off the trivial vector, off each other, to unit length
        u = F.col("root") / F.lit(max(size, 1e-300) ** 0.5)
        parts = (("ux", u * F.col("x")), ("uy", u * F.col("y")), ("xx", F.col("x") ** 2), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") ** 2))
        s = state.agg(*[F.sum(c).alias(n) for n, c in parts]).first().asDict()
        s = {n: v or 0.0 for n, v in s.items()}
        xx, yy, xy = s["xx"] - s["ux"] ** 2, s["yy"] - s["uy"] ** 2, s["xy"] - s["ux"] * s["uy"]
        nx = max(xx, 1e-300) ** 0.5
        along = xy / nx
        ny = max(yy - along * along, 1e-300) ** 0.5
        x = (F.col("x") - F.lit(s["ux"]) * u) / F.lit(nx)
        y = (F.col("y") - F.lit(s["uy"]) * u - F.lit(along) * x) / F.lit(ny)
        state = state.select("id", "root", x.alias("x"), y.alias("y"))
        last, lead = lead, (nx, ny)
        if step == steps or (step > 1 and max(abs(a - b) for a, b in zip(last, lead)) < tol):
            break
        ends = links.join(state.select(F.col("id").alias("to"), "x", "y"), "to")
        pulled = ends.groupBy("id").agg(F.sum(F.col("m") * F.col("x")).alias("px"), F.sum(F.col("m") * F.col("y")).alias("py"))
        half = lambda a, b: ((F.col(a) + F.coalesce(b, F.lit(0.0))) / 2).alias(a)
        state = staged(state.join(pulled, "id", "left").select("id", "root", half("x", "px"), half("y", "py")), "layout")
    scale = F.lit(size**0.5)
    place = lambda c: F.when(F.col("root") > 0, F.col(c) * scale / F.col("root")).otherwise(F.lit(0.0)).alias(c)
    return state.select("id", place("x"), place("y"))


def neighbour_map(df: DataFrame, features: str, row_id: str, k: int = 15, seed: int = DEFAULT_SEED, **graph) -> DataFrame:
    """Two-dimensional map by neighbourhood: (row id, x, y) for every row that has a vector. Starts from the principal axes."""
    from topicweave.operators.features import project_2d

    edges = neighbour_graph(df, features, row_id, k, seed=seed, **graph)
    if edges.isEmpty():
        return edges.select(F.col("src").alias(row_id), F.col("dist").alias("x"), F.col("dist").alias("y"))
    rows = df.where(F.col(features).isNotNull()).select(row_id, features)
    axes = project_2d(rows, features, row_id).select(F.col(row_id).cast("long").alias("id"), "x", "y")
    return spectral_layout(edges, staged(axes, "axes")).withColumnRenamed("id", row_id)
