"""Pairs of vectors without a task that holds a whole side: query sets against collections, and pairs inside groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.arrow import complete_groups, run_bounds, whole_groups
from moraine.functions.vectors import clean_vectors, matrix
from moraine.session import cut, shuffle_width

COLLECTION_BLOCK = 16_384
QUERY_BLOCK = 16_384
GROUP_BLOCK = 1_024


def exact_top_k(queries: DataFrame, collection: DataFrame, dim: int, k: int) -> DataFrame:
    """The k highest inner products of each query in each space, exactly.

    queries: query (any orderable key), vector. collection: space int, id long, vector. Output: query,
    space, id, rank (1 = best within the space; ties: smaller id), score, query_norm, entry_norm.
    Unusable vectors (null, other length, not finite, all zero) and null keys take no part; repeated
    rows of a key count once. An empty side gives an empty output.
    """
    lists = top_lists(queries, collection, dim, k)
    flat = lists.select("query", "space", "query_norm", F.posexplode("found").alias("_pos", "e"))
    return flat.select("query", "space", F.col("e.id").alias("id"), (F.col("_pos") + 1).alias("rank"), (F.lit(0.0) - F.col("e.less")).alias("score"), "query_norm", F.col("e.entry_norm").alias("entry_norm"))


def top_lists(queries: DataFrame, collection: DataFrame, dim: int, k: int) -> DataFrame:
    """exact_top_k as one row per query and space: query, space, query_norm, found: array of (less, id, entry_norm, tag),
    best first; less is the negative score, tag a long that an entry carries along if the collection has it.

    Queries are dealt into blocks of about QUERY_BLOCK and the collection is packed into rows of up to
    COLLECTION_BLOCK vectors in the checkpoint folder. A task holds one block and streams the packed rows,
    so nothing is copied to disk for each block, and keeps the best k so far. Only where the blocks are
    fewer than the cores is the collection cut into pieces whose lists are merged. Products are taken in
    single precision; what comes within their error of the k-th best is taken again in double.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)["query"]
    tag = "tag" if "tag" in collection.columns else F.lit(0).cast("long").alias("tag")
    c = clean_vectors(collection.filter("space is not null and id is not null").select("space", "id", tag, "vector"), "vector", dim)
    c = c.groupBy("space", "id").agg(F.min(F.struct("vector", "tag")).alias("v")).select("space", "id", F.col("v.tag").alias("tag"), F.col("v.vector").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in complete_groups(batches, "space", COLLECTION_BLOCK, COLLECTION_BLOCK):
            spaces = t["space"].to_numpy()
            bounds = run_bounds(spaces)
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                for at in range(int(a), int(e), COLLECTION_BLOCK):
                    some = t.slice(at, min(COLLECTION_BLOCK, int(e) - at)).combine_chunks()
                    cells = [some["id"].to_numpy().astype("<i8").tobytes(), some["tag"].to_numpy().astype("<i8").tobytes(), matrix(some["vector"], dim).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([spaces[at]], pa.int32()), *[pa.array([x], pa.binary()) for x in cells]], ["space", "ids", "tags", "rows"])

    packed = cut(c.sortWithinPartitions("space", "id").mapInArrow(pack, "space int, ids binary, tags binary, rows binary"))
    q = clean_vectors(queries.filter("query is not null").select("query", "vector"), "vector", dim)
    q = cut(q.groupBy("query").agg(F.min("vector").alias("vector")))
    cores = max(1, spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    pieces = 1 if blocks >= cores else -(-cores // blocks)
    blocks = blocks if pieces > 1 else -(-blocks // cores) * cores

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([t["query"].to_pylist()], pa.list_(t.schema.field("query").type)), pa.array([matrix(t["vector"], dim).tobytes()], pa.binary())], ["queries", "mine"])

    asked = q.repartition(blocks, "query").mapInArrow(gather, f"queries array<{kind}>, mine binary")
    found = packed.coalesce(pieces).hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(
        lambda batches: _scan(batches, dim, k), f"query {kind}, space int, query_norm double, found array<struct<less: double, id: long, entry_norm: double, tag: long>>"
    )
    if pieces == 1:
        return found
    merged = found.groupBy("query", "space").agg(F.first("query_norm").alias("query_norm"), F.flatten(F.collect_list("found")).alias("found"))
    return merged.withColumn("found", F.slice(F.array_sort("found"), 1, k))


def _scan(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The lists of a block of queries over the packed rows that come with it; a task has one block."""
    keys, lists = None, {}
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            if keys is None:
                mine = np.frombuffer(row["mine"][0].as_buffer(), "<f4").reshape(-1, dim).copy()
                keys, length = pa.array(row["queries"][0].values.to_pylist(), row["queries"].type.value_type), np.sqrt((mine.astype(np.float64) ** 2).sum(1))
            ids, tags = (np.frombuffer(row[c][0].as_buffer(), "<i8") for c in ("ids", "tags"))
            rows = np.frombuffer(row["rows"][0].as_buffer(), "<f4").reshape(-1, dim)
            best = lists.setdefault(row["space"][0].as_py(), [np.full((len(mine), k), np.inf), np.full((len(mine), k), np.iinfo(np.int64).max), np.zeros((len(mine), k)), np.zeros((len(mine), k), np.int64)])
            _meet(mine, length, rows, ids, tags, best, k)
    for space, (less, ids, norms, tags) in lists.items():
        for at in range(0, len(less), 1024):
            there = less[at : at + 1024] != np.inf
            offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(x[at : at + 1024][there]) for x in (less, ids, norms, tags)], ["less", "id", "entry_norm", "tag"])
            n = len(there)
            yield pa.RecordBatch.from_arrays([keys.slice(at, n), pa.array(np.full(n, space, np.int32)), pa.array(length[at : at + n]), pa.ListArray.from_arrays(pa.array(offsets), cells)], ["query", "space", "query_norm", "found"])


def _places(mask: np.ndarray) -> np.ndarray:
    """flatnonzero of a mask that holds little, eight places at a time."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[words])
    return words[i] * 8 + j


def _meet(mine: np.ndarray, length: np.ndarray, rows: np.ndarray, ids: np.ndarray, tags: np.ndarray, best: list[np.ndarray], k: int) -> None:
    """Take the rows into the best k (negative score, id, norm, tag) of each query."""
    wide = rows.astype(np.float64)
    norms = np.sqrt((wide**2).sum(1))
    slack = 1.2e-7 * rows.shape[1] * length * norms.max() + 1e-8
    space = np.empty((256, 2048), np.float32)  # products are written into the same pages again and again
    for at in range(0, len(mine), 256):
        q, s_ = mine[at : at + 256], slice(at, at + 256)
        full = q.astype(np.float64)
        bar = -best[0][s_, -1]
        some: list[tuple[np.ndarray, np.ndarray]] = []
        for f in range(0, len(rows), 2048):
            with np.errstate(all="ignore"):
                score = np.matmul(q, rows[f : f + 2048].T, out=space[: len(q), : len(rows) - f])
            if k <= score.shape[1] and not np.isfinite(bar).all():
                least = np.partition(score, -k, axis=1)[:, -k].astype(np.float64) - slack[s_]
                bar = np.where(np.isfinite(least), np.maximum(bar, least), bar)
            # what is no number, or too large for one, is no reason to leave an entry out
            i, j = np.divmod(_places(~(score < (bar - slack[s_]).astype(np.float32)[:, None])), score.shape[1])
            some.append((i, j + f))
        i, j = (np.concatenate(x) for x in zip(*some, strict=True))
        if not len(i):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", full[i[a : a + 32768]], wide[j[a : a + 32768]]) for a in range(0, len(i), 32768)])
        exact = np.round(exact, 9)
        go = ~(exact < -best[0][s_, -1][i])
        i, j, exact = i[go], j[go], exact[go]
        touched, where = np.unique(i, return_inverse=True)
        old = [b[s_][touched].ravel() for b in best]
        who = np.concatenate([np.repeat(np.arange(len(touched)), k), where])
        cells = [np.concatenate(x) for x in zip(old, (0.0 - exact, ids[j], norms[j], tags[j]), strict=True)]
        order = np.argsort(cells[0])
        order = order[np.argsort(who[order].astype(np.uint16), kind="stable")]
        a, b = order[:-1], order[1:]
        if ((cells[0][a] == cells[0][b]) & (who[a] == who[b]) & (cells[1][a] != cells[1][b])).any():
            order = np.lexsort((cells[1], cells[0], who))  # ties go by id
        starts = run_bounds(who[order])
        keep = order[(starts[:-1, None] + np.arange(k)).ravel()]
        for b, x in zip(best, cells, strict=True):
            b[at + touched] = x[keep].reshape(-1, k)


def group_pairs(items: DataFrame, dim: int, threshold: float, cosine: bool = False, strict: bool = True) -> DataFrame:
    """Pairs (grp, a, b, score), a < b, of items of one group with a product (or cosine) above the threshold.

    items: grp (long), item (long), vector. `strict` takes > instead of >=. Unusable vectors and null
    keys take no part; repeated rows of an item in a group count once. A group is dealt into blocks of
    about GROUP_BLOCK items and each two blocks meet in one task, so a group that holds a third of all
    rows is spread, and memory is bounded.
    """
    v = clean_vectors(items.filter("grp is not null and item is not null").select("grp", "item", "vector"), "vector", dim)
    v = cut(v.groupBy("grp", "item").agg(F.min("vector").alias("vector")))
    sizes = v.groupBy("grp").agg(F.count("*").alias("_n")).filter("_n > 1")
    dealt = v.join(sizes, "grp").withColumn("_k", F.ceil(F.col("_n") / GROUP_BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("item"), F.col("_k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.select(
        F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
        (F.least("block", "other") == F.greatest("block", "other")).alias("inner"),
        "grp", "block", "item", "vector",
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", GROUP_BLOCK, 32 * GROUP_BLOCK):
            keys, groups, ids = table["key"].to_numpy(), table["grp"].to_numpy(), table["item"].to_numpy()
            inner, block = table["inner"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
            rows = matrix(table["vector"], dim).astype(np.float64)
            if cosine:
                rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            bounds = run_bounds(keys)
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                for p in range(a, e, 1024):
                    o = min(p + 1024, e)
                    s = rows[p:o] @ rows[a:e].T
                    i, j = np.nonzero(s > threshold if strict else s >= threshold)
                    value = s[i, j]
                    i, j = i + p, j + a
                    go = (ids[i] < ids[j]) & (groups[i] == groups[j]) & (inner[i] | (block[i] != block[j]))
                    i, j = i[go], j[go]
                    yield pa.RecordBatch.from_arrays([pa.array(groups[i]), pa.array(ids[i]), pa.array(ids[j]), pa.array(value[go])], ["grp", "a", "b", "score"])

    kind = dict(v.dtypes)["grp"]
    return (
        dealt.repartition(shuffle_width(items.sparkSession), "key").sortWithinPartitions("key").mapInArrow(pairs, f"grp {kind}, a long, b long, score double")
    )
