"""The most similar vectors for every query vector, by an adaptive scan of rotated dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.vectors import clean_vectors, matrix, rotation
from moraine.session import cut, shuffle_width

SAMPLE_ROWS = 16_384  # vectors the lists are fitted on, and from which first thresholds come
MAX_LISTS = 2_048
MAX_GROUP_ROWS = 65_536  # collection vectors in a task's memory
QUERY_BATCH = 512
SEED_ROWS = 4_096
TILE = 2_048
LIST_Z = 16.0  # true neighbours lay at most 14 deviations from their centre, along the query, where it was measured


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centroids of a k-means on a bounded sample; an empty list keeps its last centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(sample, centres)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
        sums = np.add.reduceat(sample[order].astype(np.float64), starts, axis=0)
        counts = np.diff(np.append(starts, len(order)))
        centres[near[order][starts]] = (sums / counts[:, None]).astype(np.float32)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres.astype(np.float64) ** 2).sum(1).astype(np.float32)
    out = np.empty(len(rows), np.int32)
    for at in range(0, len(rows), 4096):
        out[at : at + 4096] = np.argmax(rows[at : at + 4096] @ centres.T - half, axis=1)
    return out


class ScanIndex:
    """A part of the collection, list by list, rotated, with the norms up to the end of each column block."""

    def __init__(self, ids: np.ndarray, spaces: np.ndarray, lists: np.ndarray, rows: np.ndarray, turn: np.ndarray, block: int, z: float):
        order = np.lexsort((ids, spaces, lists))
        self.ids, self.spaces, self.rows, lists = ids[order], spaces[order], rows[order], lists[order]
        bounds = np.concatenate([[0], np.flatnonzero(lists[1:] != lists[:-1]) + 1, [len(lists)]])
        # a list of equal or very many vectors is scanned in tiles, so the pair matrix stays bounded
        self.tiles = [(a, min(a + TILE, e)) for s, e in zip(bounds[:-1], bounds[1:], strict=True) for a in range(s, e, TILE)]
        dim = rows.shape[1]
        self.turn, self.edges = turn, [*range(0, dim, block), dim]
        # share of a squared distance seen in the first d dimensions: mean d / D, plus z deviations
        done = np.array(self.edges[1:], float)
        self.shares = done / dim + z * np.sqrt(2 * done * (dim - done) / (dim * dim * (dim + 2)))
        self.turned = self.rows @ turn
        self.norms = np.sqrt((self.rows.astype(np.float64) ** 2).sum(1))
        self.side = (-0.5 * self._side(self.turned)).astype(np.float32)
        # with a column of ones and of -need beside a query, one matrix product is its first test
        self.first = np.column_stack([self.turned[:, : self.edges[1]], self.side[0], np.ones(len(rows), np.float32)])
        self.centres = np.array([self.turned[a:e].mean(0) for a, e in self.tiles], np.float32)
        squares = [((self.turned[a:e] - c) ** 2).sum(1) for (a, e), c in zip(self.tiles, self.centres, strict=True)]
        # how far a row may lie from its centre along a query: never more than the radius, and LIST_Z deviations of a random direction
        self.radii = np.array([min(np.sqrt(q.max()), LIST_Z * np.sqrt(q.mean() / dim)) for q in squares], np.float32)

    def _side(self, turned: np.ndarray) -> np.ndarray:
        """Per column block j: squared norm of the dimensions so far, less shares[j] times the whole."""
        seen = np.cumsum(turned.astype(np.float64) ** 2, axis=1)[:, np.array(self.edges[1:]) - 1]
        return (seen - self.shares[None, :] * seen[:, -1:]).T

    def search(self, rows: np.ndarray, k: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, inner product) of the k best of each query, ties by (space, id).

        An inner product above a bar means a squared distance below r2 = |q|2 + |x|2 - 2 bar. Under a
        random rotation the distance within the first d of D dimensions has mean r2 d/D and deviation
        r2 sqrt(2 d (D - d) / (D2 (D + 2))); after each column block, candidates whose distance so far
        is more than z deviations above that mean are abandoned. The bar of a query is its k-th best
        product. Where many candidates of a query survive, the next block is one matrix product over
        the list, else single pairs are followed. A list is probed if its centre's product with the
        query, plus LIST_Z deviations of its rows along a random direction, or a Cauchy-Schwarz bound
        where that is smaller, reaches the bar.
        """
        turned = rows @ self.turn
        wide = rows.astype(np.float64)
        norms = np.sqrt((wide**2).sum(1))
        side = 0.5 * self._side(turned)
        slack = 1e-5 * norms * (self.norms.max() if len(self.norms) else 0.0)
        bar = floor - slack
        blocks = [slice(lo, hi) for lo, hi in zip(self.edges[:-1], self.edges[1:], strict=True)]
        final = len(blocks) - 1
        affinity = turned @ self.centres.T
        reach = affinity + np.outer(norms, self.radii)
        asked = np.column_stack([turned[:, : self.edges[1]], np.ones(len(rows), np.float32), np.zeros(len(rows), np.float32)])
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64))
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def need(j: int, q: np.ndarray) -> np.ndarray:
            return (side[j, q] + self.shares[j] * bar[q]).astype(np.float32)

        # lists most likely to hold good matches first: bars rise early
        for t in np.argsort(-affinity.max(0, initial=-np.inf), kind="stable"):
            a, e = self.tiles[t]
            who = np.flatnonzero(reach[:, t] >= bar)
            if not len(who):
                continue
            least = need(0, who)
            unbarred = np.isneginf(least)
            least[unbarred] = 0
            asked[who, -1] = -least
            so_far = asked[who] @ self.first[a:e].T
            alive = so_far >= 0
            alive[unbarred] = True
            for j, block in enumerate(blocks):
                if not len(who):
                    break
                if j:
                    so_far += turned[who, block] @ self.turned[a:e, block].T
                    alive = so_far + self.side[j, a:e] >= need(j, who)[:, None]
                total = np.count_nonzero(alive)
                if not total:
                    break
                few = total <= alive.size // 16
                at = np.flatnonzero(alive) if few else None
                q = at // (e - a) if few else None
                count = np.bincount(q, minlength=len(who)) if few else alive.sum(1)
                dense = (count > (e - a) // 8) & (j < final)
                if not dense.all():
                    if not few:
                        alive[dense] = False
                        at = np.flatnonzero(alive)
                        q = at // (e - a)
                    elif dense.any():
                        at, q = at[~dense[q]], q[~dense[q]]
                    x = at - q * (e - a)
                    sums = so_far[q, x]
                    if not j:
                        sums += least[q] - self.side[0, a + x]
                    q, x = who[q], x + a
                    for at in range(0, len(q), 65_536):  # pairs in bounded pieces
                        qq, xx, ss = q[at : at + 65_536], x[at : at + 65_536], sums[at : at + 65_536]
                        for i in range(j + 1, final + 1):
                            ss = ss + np.einsum("ij,ij->i", turned[qq, blocks[i]], self.turned[xx, blocks[i]])
                            go = ss + self.side[i, xx] >= need(i, qq)
                            qq, xx, ss = qq[go], xx[go], ss[go]
                            if not len(qq):
                                break
                        if len(qq):
                            fresh.append((qq, xx))
                            waiting += len(qq)
                who, so_far = who[dense], so_far[dense]
                if not j and len(who):
                    so_far += least[dense][:, None]
                    so_far -= self.side[0, a:e]
            if waiting >= 256:
                best, fresh, waiting = self._keep(best, fresh, wide, k, bar, slack), [], 0
        return self._keep(best, fresh, wide, k, bar, slack) if fresh else best

    def _keep(self, best: tuple, fresh: list[tuple[np.ndarray, np.ndarray]], wide: np.ndarray, k: np.ndarray, bar: np.ndarray, slack: np.ndarray):
        """The k best of each query so far, with the exact products of the fresh pairs; raises the bars."""
        q, x = (np.concatenate(part) for part in zip(*fresh, strict=True))
        s = np.concatenate([(wide[a] * self.rows[b].astype(np.float64)).sum(1) for a, b in fresh])
        touched = np.zeros(len(wide), bool)
        touched[q] = True
        mine = touched[best[0]]  # only these queries are sorted again
        rest = [part[~mine] for part in best]
        q, x, s = np.append(best[0][mine], q), np.append(best[1][mine], x), np.append(best[2][mine], s)
        order = np.lexsort((self.ids[x], self.spaces[x], -s, q))
        q, x, s = q[order], x[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = place == k[q] - 1
        bar[q[last]] = np.maximum(bar[q[last]], s[last] - slack[q[last]])
        keep = place < k[q]
        return tuple(np.append(a, b[keep]) for a, b in zip(rest, (q, x, s), strict=True))


def most_similar(
    collection: DataFrame, queries: DataFrame, dim: int, block: int = 32, z: float = 4.0, seed: int = 11, least_cosine: float | None = None
) -> DataFrame:
    """For each query the entries with the top_k highest inner products; with `least_cosine`, those of them whose cosine reaches it.

    collection: space int, id long, vector (array or binary). queries: query_id long, top_k int,
    vector. Output: query_id, space, id, score, cosine. Ties: smaller space, then smaller id.
    Vectors that are null, of another length, hold NaN or infinity or zeros only, null keys, and
    queries with a null or non-positive top_k take no part; of repeated rows of a key the one with
    the least bytes counts. Fewer entries than top_k: all of them. Empty inputs: empty output.

    Index: k-means lists fitted on the SAMPLE_ROWS vectors of least hash; every vector is indexed.
    The lists, in order, are packed into groups of at most MAX_GROUP_ROWS vectors (longer lists are
    cut), queries into blocks, and each (group, block) is one task that holds a group and streams
    the block's queries. Numbers of groups and blocks are chosen to move the fewest bytes. Each
    query carries a first threshold, its k-th best product within SEED_ROWS sample vectors. With a
    positive least_cosine it is least_cosine times the norms of the query and of the shortest entry, if
    that is more: no entry of a smaller product reaches the cosine, or stands before one that does. The
    work still grows as queries times entries. The only
    loss comes from the tests: of candidates at z deviations, of lists at LIST_Z.
    """
    spark = collection.sparkSession
    c = clean_vectors(collection.filter("space is not null and id is not null").select("space", "id", "vector"), "vector", dim)
    c = cut(c.groupBy("space", "id").agg(F.min("vector").alias("vector")))
    q = clean_vectors(queries.filter("query_id is not null and top_k > 0").select("query_id", "top_k", "vector"), "vector", dim)
    q = cut(q.groupBy("query_id").agg(F.min(F.struct("top_k", "vector")).alias("r")).select("query_id", "r.top_k", "r.vector"))
    rows, asked = c.count(), q.count()
    if not rows or not asked:
        return spark.createDataFrame([], "query_id long, space int, id long, score double, cosine double")

    drawn = c.orderBy(F.xxhash64("space", "id")).limit(SAMPLE_ROWS).select("vector").toArrow()["vector"]
    sample = matrix(drawn, dim)
    lists = int(min(MAX_LISTS, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(rows))))), len(sample)))
    centres = spark.sparkContext.broadcast(fit_lists(sample, lists))  # at most MAX_LISTS vectors
    seeds = spark.sparkContext.broadcast(np.ascontiguousarray(sample[:SEED_ROWS]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine = matrix(batch.column(2), dim)
                length = np.sqrt((mine.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(mine, centres.value)), pa.array(length)], ["space", "id", "vector", "list", "norm"])

    c = cut(c.mapInArrow(assign, "space int, id long, vector binary, list int, norm double"))
    summed = c.groupBy("list").agg(F.count("*").alias("n"), F.min("norm").alias("norm")).collect()  # at most MAX_LISTS rows
    held = {r["list"]: r["n"] for r in summed}
    shortest = min(r["norm"] for r in summed)

    tasks = max(12, 2 * shuffle_width(spark))
    groups = max(1, min(tasks, round(math.sqrt(tasks * rows / asked))))
    groups = max(groups, -(-rows // MAX_GROUP_ROWS))
    blocks = max(1, round(tasks / groups))
    room = -(-rows // groups)
    plan, filled = [], 0
    for name in sorted(held):  # list -> the stretch of rows it fills; a stretch over several groups is cut by hash
        plan.append((name, filled, held[name]))
        filled += held[name]
    groups = (filled - 1) // room + 1
    where = F.broadcast(spark.createDataFrame(plan, "list int, from_row long, n_rows long"))
    spread = F.pmod(F.xxhash64(F.lit(3), "space", "id"), F.lit(1 << 20)).cast("double") / (1 << 20)
    group = F.floor((F.col("from_row") + F.floor(spread * F.col("n_rows"))) / room).cast("int")
    placed = c.join(where, "list").select(
        F.explode(F.sequence(group * blocks, group * blocks + blocks - 1)).alias("task"), F.lit(0).alias("tag"),
        "list", "space", "id", F.lit(0).alias("top_k"), F.lit(0.0).alias("floor"), "vector",
    )

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(1).to_numpy().astype(np.int64)
            mine = matrix(batch.column(2), dim)
            floor = np.full(len(k), -np.inf)
            if least_cosine is not None and least_cosine > 0:
                floor = least_cosine * shortest * np.sqrt((mine.astype(np.float64) ** 2).sum(1))
            for at in range(0, len(k), 1024):
                s = mine[at : at + 1024] @ seeds.value.T
                kk = k[at : at + 1024]
                ok = np.flatnonzero((s >= floor[at : at + 1024, None]).sum(1) >= kk)  # others have no k-th product above the floor
                floor[at + ok] = np.sort(s[ok], axis=1)[np.arange(len(ok)), s.shape[1] - kk[ok]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["query_id", "top_k", "vector", "floor"])

    q = q.mapInArrow(thresholds, "query_id long, top_k int, vector binary, floor double")
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    sent = q.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * blocks + block_of)).alias("task"), F.lit(1).alias("tag"),
        F.lit(0).alias("list"), F.lit(0).alias("space"), F.col("query_id").alias("id"), "top_k", "floor", "vector",
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        task, index, parts = None, None, []

        def build() -> ScanIndex:
            table = pa.Table.from_batches(parts).combine_chunks()
            return ScanIndex(
                table["id"].to_numpy(), table["space"].to_numpy(), table["list"].to_numpy(), matrix(table["vector"], dim), turn, block, z
            )

        for batch in batches:
            names = batch.column(0).to_numpy()
            tags = batch.column(1).to_numpy()
            edge = np.flatnonzero((names[1:] != names[:-1]) | (tags[1:] != tags[:-1])) + 1
            for a, e in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(names)]]), strict=True):
                if a == e:
                    continue
                piece = batch.slice(int(a), int(e - a))
                if names[a] != task:
                    task, index, parts = names[a], None, []
                if tags[a] == 0:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                if index is None:
                    index = build()
                for at in range(0, piece.num_rows, QUERY_BATCH):
                    some = piece.slice(at, QUERY_BATCH)
                    mine = matrix(some.column(7), dim)
                    k = some.column(5).to_numpy().astype(np.int64)
                    qn, xn, score = index.search(mine, k, some.column(6).to_numpy())
                    length = np.sqrt((mine.astype(np.float64) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some.column(4).to_numpy()[qn]), pa.array(some.column(5).to_numpy()[qn]), pa.array(index.spaces[xn]),
                            pa.array(index.ids[xn]), pa.array(score), pa.array(score / (length[qn] * index.norms[xn])),
                        ],
                        ["query_id", "top_k", "space", "id", "score", "cosine"],
                    )

    n = groups * blocks
    found = (
        placed.unionByName(sent)
        .repartitionById(n, F.col("task"))
        .sortWithinPartitions("task", "tag")
        .mapInArrow(scan, "query_id long, top_k int, space int, id long, score double, cosine double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "space", "id")
    best = found.withColumn("_place", F.row_number().over(order)).filter("_place <= top_k").drop("_place", "top_k")
    return best if least_cosine is None else best.filter(F.col("cosine") >= least_cosine)
