"""Similarity clusters by reciprocal-nearest-neighbour average linkage on a sparse graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.arrow import complete_groups, run_bounds, whole_groups
from moraine.functions.vectors import binary, clean_vectors, matrix, rotation
from moraine.operators.graph import connected_components
from moraine.operators.clustering import mean_vectors
from moraine.session import cut, release, shuffle_width

HALF_ERROR = 2e-3  # of a product of two vectors of length 1 at half precision: below 2 x 2^-11 + 2^-22
WINDOW = 512  # rows compared with each other at once
MAX_COMPONENT = 2_048  # nodes merged inside one task; larger components merge round by round
PAIR_BLOCK = 1_024
MAX_EPOCHS = 40
EXACT_BLOCK = 8_192  # nodes of a block, up to 8 times as many with many nodes, so that each is copied less
STRIP = 1 << 22  # similarities held at once
MISS = 1e-3  # chance of missing a pair at the threshold that `empty_epochs` counts for


def polytope_codes(rows: np.ndarray, seed: int, count: int) -> np.ndarray:
    """`count` cross-polytope hashes per row: the nearest signed axis after a random rotation."""
    dim = rows.shape[1]
    codes = np.empty((len(rows), count), np.int64)
    for j in range(count):
        turned = rows @ rotation(dim, seed * 1009 + j)
        top = np.abs(turned).argmax(1)
        codes[:, j] = 2 * top + (turned[np.arange(len(rows)), top] < 0)
    return codes


def _windows(keys: np.ndarray, size: int, whole: bool = False) -> Iterator[tuple[int, int]]:
    """Stretches of at most `size` rows that do not cut a run of equal keys; a longer run is cut, or kept `whole`."""
    bounds = run_bounds(keys)
    a = 0
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - a > size and s > a:
            yield int(a), int(s)
            a = s
        while e - a > size and not whole:
            yield int(a), int(a + size)
            a += size
    if a < len(keys):
        yield int(a), int(len(keys))


def halves(rows: np.ndarray) -> pa.Array:
    """Rows as binaries of half-precision numbers."""
    n, dim = rows.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (dim * 2))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows, "<f2").tobytes())])


def unhalved(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], "<f2", count=len(column) * dim, offset=start).reshape(len(column), dim).astype(np.float32)


def similarity_graph(nodes: DataFrame, dim: int, threshold: float, tables: int, neighbours: int, seed: int) -> DataFrame:
    """Edges (a, b, sim) with a < b between nodes (node, vector) of similarity >= threshold.

    Each node goes into `tables` buckets named by two cross-polytope hashes. Buckets are sorted, with
    a third hash as the order inside, and range-partitioned by all of it, so a bucket that holds a
    third of all nodes spreads over tasks; rows are compared in windows of WINDOW rows. A node keeps
    its best `neighbours` per window; what a cap or an unlucky hash leaves out may be found when the
    graph is built again on the merged clusters. Vectors travel as half-precision numbers, so sim is off
    by up to HALF_ERROR, and edges down to that much below the threshold come along: merging decides
    by the whole vectors.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1), dim)
            for t in range(tables):
                code = polytope_codes(rows, seed * 131 + t, 3)
                key = (np.int64(t) << 40) | (code[:, 0] << 20) | code[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(code[:, 2]), batch.column(0), halves(rows)], ["key", "fine", "node", "vector"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in complete_groups(batches, "key", target=4 * WINDOW, limit=8 * WINDOW):
            keys, ids, rows = table["key"].to_numpy(), table["node"].to_numpy(), unhalved(table["vector"], dim)
            for a, e in _windows(keys, WINDOW):
                s = rows[a:e] @ rows[a:e].T
                np.fill_diagonal(s, -2)
                i, j = np.nonzero(s >= threshold - HALF_ERROR)
                if not len(i):
                    continue
                value = s[i, j]
                order = np.lexsort((ids[a + j], -value, i))
                i, j, value = i[order], j[order], value[order]
                starts = run_bounds(i)
                place = np.arange(len(i)) - np.repeat(starts[:-1], np.diff(starts))
                keep = (place < neighbours) & (ids[a + i] != ids[a + j])
                x, y = ids[a + i[keep]], ids[a + j[keep]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(value[keep].astype(np.float64))], ["a", "b", "sim"]
                )

    parts = shuffle_width(nodes.sparkSession)
    buckets = nodes.select("node", "vector").mapInArrow(hashed, "key long, fine long, node long, vector binary")
    buckets = buckets.repartitionByRange(parts, "key", "fine", "node").sortWithinPartitions("key", "fine", "node")
    return buckets.mapInArrow(compare, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def exact_graph(nodes: DataFrame, dim: int, threshold: float, count: int) -> DataFrame:
    """All edges (a, b, sim) with a < b between the `count` nodes (node, vector) of similarity >= threshold.

    Nodes are dealt into blocks of about EXACT_BLOCK, or 8 times that, and each two blocks meet in a task.
    """
    block = EXACT_BLOCK * min(8, max(1, round(count / (16 * EXACT_BLOCK))))
    k = max(1, math.ceil(count / block))
    rows = nodes.select("node", "vector").withColumn("block", F.pmod(F.xxhash64("node"), F.lit(k)).cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    rows = rows.select((F.least("block", "other") * k + F.greatest("block", "other")).alias("key"), (F.col("block") > F.col("other")).alias("second"), "node", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 2 * block, 8 * block):
            keys, ids, vectors = table["key"].to_numpy(), table["node"].to_numpy(), matrix(table["vector"], dim)
            second = table["second"].to_numpy(zero_copy_only=False)
            bounds = run_bounds(keys)
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                m = e - int(second[a:e].sum())  # rows of the second block come last
                same = keys[a] // k == keys[a] % k
                start = a if same else m
                strip = max(1, min(512, STRIP // max(1, e - start)))
                for p in range(a, m, strip):
                    o = min(p + strip, m)
                    s = vectors[p:o] @ vectors[start:e].T
                    at = np.flatnonzero(s >= threshold - 1e-5)
                    i, j = at // (e - start), at % (e - start)
                    value = (vectors[p + i].astype(np.float64) * vectors[start + j].astype(np.float64)).sum(1)
                    x, y = ids[p + i], ids[start + j]
                    keep = (value >= threshold) & (x < y if same else x != y)
                    x, y, value = x[keep], y[keep], value[keep]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(value)], ["a", "b", "sim"])

    parts = shuffle_width(nodes.sparkSession)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "second").mapInArrow(compare, "a long, b long, sim double")


def empty_epochs(dim: int, threshold: float, tables: int, trials: int = 4_000) -> int:
    """How many epochs in a row have to find nothing, so that a pair at the threshold is missed with a chance of about MISS.

    The chance of one epoch is counted over random pairs, as if rows met in equal buckets only and
    there always; windows across buckets find more, buckets cut at WINDOW rows and full caps less.
    """
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    c = min(1.0, max(-1.0, threshold))
    y = c * x + math.sqrt(1 - c * c) * y
    met = np.zeros(trials, bool)
    for t in range(tables):
        met |= (polytope_codes(x, t, 2) == polytope_codes(y, t, 2)).all(1)
    missed = min(1 - 1 / trials, max(1 / trials, 1 - met.mean()))
    return max(1, math.ceil(math.log(MISS) / math.log(missed)))


def reciprocal_merges(means: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage cluster number of each row: the smallest row number of its cluster.

    The average similarity of two clusters is the product of their mean vectors. Each round merges
    all pairs that are each other's best partner (ties: the smaller row number) and reach the
    threshold. As average linkage is reducible, that gives the clusters of one merge at a time.
    """
    n = len(means)
    label = np.arange(n)
    mean, size = means.astype(np.float64).copy(), sizes.astype(np.float64).copy()
    s = mean @ mean.T
    s = np.maximum(s, s.T)
    np.fill_diagonal(s, -np.inf)
    while True:
        best = s.argmax(1)
        value = s[np.arange(n), best]
        i = np.flatnonzero((value >= threshold) & (best[best] == np.arange(n)) & (np.arange(n) < best))
        if not len(i):
            return label
        j = best[i]
        total = size[i] + size[j]
        mean[i] = (mean[i] * size[i][:, None] + mean[j] * size[j][:, None]) / total[:, None]
        size[i] = total
        gone = np.full(n, -1)
        gone[j] = i
        moved = gone[label] >= 0
        label[moved] = gone[label[moved]]
        row = mean[i] @ mean.T
        dead = np.isneginf(s).all(1)
        dead[j] = True
        row[:, dead] = -np.inf
        s[j, :] = -np.inf
        s[:, j] = -np.inf
        s[i, :] = row
        s[:, i] = row.T
        s[i, i] = -np.inf
        # pairs of two merged clusters, equal seen from either side
        both = np.maximum(s[np.ix_(i, i)], s[np.ix_(i, i)].T)
        s[np.ix_(i, i)] = both


def _merge_epoch(nodes: DataFrame, edges: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, bool]:
    """(node, into, vector, size): nodes of components with edges; vector and size only where node = into.
    And whether all components were merged to the end."""
    spark = nodes.sparkSession
    comps = connected_components(edges.select("a", "b"))
    wide = comps.groupBy("comp").agg(F.count("*").alias("_n")).filter(F.col("_n") > MAX_COMPONENT).select("comp")
    large = cut(comps.join(wide, "comp", "left_semi"))
    small = comps.join(wide, "comp", "left_anti") if not large.isEmpty() else comps
    schema = "node long, into long, vector binary, size long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "comp", 4 * MAX_COMPONENT, 8 * MAX_COMPONENT):
            keys, ids = table["comp"].to_numpy(), table["node"].to_numpy()
            rows, sizes = matrix(table["vector"], dim), table["size"].to_numpy()
            into = np.empty(len(ids), np.int64)
            total = np.zeros(len(ids), np.int64)
            mean = np.zeros((len(ids), dim), np.float64)
            bounds = run_bounds(keys)
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                label = a + reciprocal_merges(rows[a:e], sizes[a:e], threshold)
                into[a:e] = label
                np.add.at(total, label, sizes[a:e])
                np.add.at(mean, label, rows[a:e].astype(np.float64) * sizes[a:e][:, None])
            own = into == np.arange(len(ids))
            mean[own] /= total[own][:, None]
            out = binary(mean.astype(np.float32)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ids[into]), pa.array([v if o else None for v, o in zip(out, own, strict=True)], pa.binary()), pa.array(np.where(own, total, 0))],
                ["node", "into", "vector", "size"],
            )

    grouped = small.join(nodes, "node").select("comp", "node", "vector", "size").repartition(shuffle_width(spark), "comp")
    done = grouped.sortWithinPartitions("comp", "node").mapInArrow(local, schema)
    if large.isEmpty():
        return done, True

    # one round of mutual best pairs inside the large components
    inside = edges.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    both = inside.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "sim"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))).alias("e"))
    best = both.groupBy("e.x").agg(F.max(F.struct(F.col("e.sim").alias("sim"), (-F.col("e.y")).alias("m"))).alias("top"))
    best = best.select("x", (-F.col("top.m")).alias("y"))
    pair = best.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
    pair = cut(pair)
    joined = pair.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("va"), F.col("size").alias("na")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb"), F.col("size").alias("nb")), "b"
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            na, nb = t["na"].to_numpy()[:, None], t["nb"].to_numpy()[:, None]
            mean = (matrix(t["va"], dim) * na + matrix(t["vb"], dim) * nb) / np.maximum(1, na + nb)
            a = t["a"].combine_chunks()
            yield pa.RecordBatch.from_arrays([a, a, binary(mean.astype(np.float32)), pa.array((na + nb).ravel())], ["node", "into", "vector", "size"])

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if batch.num_rows:
                s = (matrix(t["va"], dim).astype(np.float64) * matrix(t["vb"], dim).astype(np.float64)).sum(1)
                yield batch.filter(pa.array(s >= threshold))

    kind = "a long, b long, va binary, vb binary, na long, nb long"
    joined = cut(joined.select("a", "b", "va", "vb", "na", "nb").mapInArrow(reaching, kind))
    kept = joined.mapInArrow(unite, schema)
    left = joined.select(F.col("b").alias("node"), F.col("a").alias("into"), F.lit(None).cast("binary").alias("vector"), F.lit(0).cast("long").alias("size"))
    return done.unionByName(kept).unionByName(left), False


def average_linkage(
    items: DataFrame, dim: int, threshold: float = 0.8, tables: int = 8, neighbours: int = 8, seed: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(members, vectors): members has item and cluster (the smallest item of the cluster) for each
    usable item, vectors has item and vector (unit length, binary).

    items: item long, vector (binary or array). Items that are null, or whose vector is null, of
    another length, not finite or zero take no part; of repeated rows of an item the one with the
    least bytes counts. Equal vectors are one node of the graph that stands for all of them. Empty
    input: empty outputs.

    An epoch builds the sparse graph of all pairs of current clusters with average similarity of at
    least the threshold, and merges reciprocal nearest neighbours: clusters in different components
    cannot merge, so a component is merged to the end in one task if it has at most MAX_COMPONENT
    nodes; larger ones merge their mutual best pairs, about half of their nodes, and come again in
    the next epoch. The graph is then built anew with fresh rotations, until an epoch takes away less
    than a tenth of the clusters. From then on, whatever the size of the input, graphs hold all pairs
    of clusters, and the work ends when none of these can merge; no pair that reaches the threshold is
    left to chance. That takes half the square of the number of clusters left in products.
    """
    unit = clean_vectors(items.filter("item is not null").select("item", "vector"), "vector", dim, unit=True)
    unit = cut(unit.groupBy("item").agg(F.min("vector").alias("vector")))
    same = unit.groupBy(F.sha2("vector", 256).alias("h")).agg(F.min("item").alias("node"), F.first("vector").alias("vector"), F.count("*").alias("size"))
    same = cut(same)
    members = cut(
        unit.select("item", F.sha2("vector", 256).alias("h")).join(same.select("h", "node"), "h").select("item", F.col("node").alias("cluster"))
    )
    nodes = same.select("node", "vector", "size")
    count, exact, epoch = nodes.count(), False, 0
    while epoch < MAX_EPOCHS:
        if exact:
            edges = cut(exact_graph(nodes, dim, threshold, count))
        else:
            edges = cut(similarity_graph(nodes, dim, threshold, tables, neighbours, seed + epoch))
        epoch += 1
        moves, ended = None, True
        if not edges.isEmpty():
            merged, ended = _merge_epoch(nodes, edges, dim, threshold)
            merged = cut(merged)
            moves = merged.filter("node <> into").select(F.col("node").alias("cluster"), "into")
        if moves is None or moves.isEmpty():
            release(edges)
            if exact:
                return members, unit
            exact = True
            continue
        old = members, nodes, edges, merged
        members = cut(members.join(moves, "cluster", "left").select("item", F.coalesce("into", "cluster").alias("cluster")))
        stay = nodes.join(merged.select("node"), "node", "left_anti")
        nodes = cut(stay.unionByName(merged.filter("node = into").select("node", "vector", "size")))
        release(*old)
        if exact and ended:  # no pair across components of the whole graph reaches the threshold, so no two clusters do
            return members, unit
        before, count = count, nodes.count()
        exact = exact or count > 0.9 * before
    raise RuntimeError(f"clusters still merge after {MAX_EPOCHS} epochs")


def cluster_pairs(members: DataFrame, vectors: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(item_a, item_b), item_a < item_b: pairs inside a cluster whose own cosine reaches the threshold.

    A cluster is dealt into blocks of about PAIR_BLOCK items and each two blocks meet in a task, so a
    large cluster is spread over tasks and none holds it whole.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / PAIR_BLOCK).cast("int")
    rows = members.join(sizes, "cluster").withColumn("_k", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("_k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select("item", "cluster", "block", F.least("block", "other").alias("_i"), F.greatest("block", "other").alias("_j"))
    rows = rows.join(vectors, "item").select(F.xxhash64("cluster", "_i", "_j").alias("key"), "cluster", (F.col("_i") == F.col("_j")).alias("inner"), "block", "item", "vector")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 2 * PAIR_BLOCK, 16 * PAIR_BLOCK):
            keys, ids, rows_ = table["key"].to_numpy(), table["item"].to_numpy(), matrix(table["vector"], dim)
            cluster, inner, block = table["cluster"].to_numpy(), table["inner"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
            for a, e in _windows(keys, PAIR_BLOCK, whole=True):
                for p in range(a, e, 2048):  # bounds the similarity matrix
                    o = min(p + 2048, e)
                    s = rows_[p:o] @ rows_[a:e].T
                    i, j = np.nonzero(s >= threshold - 1e-5)
                    i, j = i + p, j + a
                    go = (keys[i] == keys[j]) & (cluster[i] == cluster[j]) & (ids[i] < ids[j]) & (inner[i] | (block[i] != block[j]))
                    i, j = i[go], j[go]
                    sure = (rows_[i].astype(np.float64) * rows_[j].astype(np.float64)).sum(1) >= threshold - 1e-7
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[sure]]), pa.array(ids[j[sure]])], ["item_a", "item_b"])

    return (
        rows.repartition(shuffle_width(members.sparkSession), "key").sortWithinPartitions("key").mapInArrow(pairs, "item_a long, item_b long")
    )


def typical_members(members: DataFrame, vectors: DataFrame, names: DataFrame, dim: int, top: int = 3) -> DataFrame:
    """One row per cluster: cluster, size, typical: its `top` items nearest to the mean, with names and nearness.

    names: item, name (may be null). Means are summed on the map side and joined back to the members,
    where a hot cluster splits like any skewed join; the window keeps `top` rows before it shuffles.
    """
    placed = cut(members.join(vectors, "item").select("cluster", "item", "vector"))
    means = mean_vectors(placed.select("cluster", "vector"), dim, "cluster").select("cluster", F.col("vector").alias("mean"), F.col("n").alias("size"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            mean = matrix(t["mean"], dim).astype(np.float64)
            s = (matrix(t["vector"], dim).astype(np.float64) * mean).sum(1) / np.maximum(np.linalg.norm(mean, axis=1), 1e-30)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.round(s, 6))], ["cluster", "size", "item", "nearness"])

    scored = placed.join(means, "cluster").select("cluster", "size", "item", "vector", "mean").mapInArrow(near, "cluster long, size long, item long, nearness double")
    order = Window.partitionBy("cluster").orderBy(F.col("nearness").desc(), "item")
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    label = names.filter("item is not null").groupBy("item").agg(F.min("name").alias("name"))
    return best.join(label, "item", "left").groupBy("cluster").agg(
        F.first("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("place", "item", "name", "nearness"))).alias("typical"),
    )
