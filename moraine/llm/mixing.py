"""Mixing sources to target weights by token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import hash_uniform, running_weight
from moraine.session import cut

MAX_SOURCES = 10_000
MAX_PLAN_ROWS = 200_000


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, applied to index (vectorised).

    A balanced Feistel network over the next even number of bits; values that fall outside the range
    walk on along their cycle until they are inside, which keeps the map a permutation.
    """
    size = size.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64))
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = index.astype(np.uint64)
    todo = np.ones(len(value), bool)
    while todo.any():
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for r in range(rounds):
            mixed = right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            mixed ^= mixed >> np.uint64(30)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(27)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            left, right = right, left ^ (mixed & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo[todo] = value[todo] >= size[todo]
    return value.astype(np.int64)


def fill(weights: np.ndarray, caps: np.ndarray, total: float, lack: str = "spread") -> np.ndarray:
    """What each source should give, at most its cap.

    'spread' keeps the total: a source at its cap stays there, and what it lacks goes to the others in
    proportion to their weights, as long as any is open. 'shrink' takes the largest total, not above the
    given one, at which every source with something to give holds exactly its weight among these.
    """
    w = np.where(caps > 0, weights, 0.0).astype(float)
    if lack == "shrink":
        if not w.sum():
            return np.zeros(len(w))
        w = w / w.sum()
        some = w > 0
        return w * min(total, float((caps[some] / w[some]).min()))
    if lack != "spread":
        raise ValueError("lack is 'spread' or 'shrink'")
    out, open_ = np.zeros(len(w)), w > 0
    while open_.any():
        out[open_] = w[open_] / w[open_].sum() * max(0.0, total - out[~open_].sum())
        over = open_ & (out > caps)
        if not over.any():
            break
        out[over] = caps[over]
        open_ &= ~over
    return out


def shard_counts(aims: np.ndarray, caps: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources): multinomial draws of the aims per shard.

    A source drawn more often than its cap is thinned to it evenly over the shards (a hypergeometric
    draw), and the places set free are drawn again among the sources below their caps, so that no place
    stays empty while any source has blocks left.
    """
    caps = np.asarray(caps, np.int64)
    if not len(aims) or aims.sum() <= 0:
        return np.zeros((shards, len(aims)), np.int64)
    rng = np.random.default_rng(seed)
    slots = int(round(float(aims.sum())))
    empty = np.full(shards, slots // shards, np.int64)
    empty[: slots % shards] += 1
    counts, p = np.zeros((shards, len(aims)), np.int64), aims / aims.sum()
    while True:
        counts += rng.multinomial(empty, p)
        before = counts.sum(1)
        for k in np.flatnonzero(counts.sum(0) > caps):
            counts[:, k] = rng.multivariate_hypergeometric(counts[:, k], int(caps[k]), method="marginals")
        empty = before - counts.sum(1)
        room = np.where(aims > 0, caps - counts.sum(0), 0)
        if not empty.any() or not room.any():
            return counts
        p = np.where(room > 0, aims, 0.0)
        p = p / p.sum()


def split_counts(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of a stretch of places dealt to its shards, as even as whole numbers allow (shards x sources)."""
    left, out = counts.astype(np.int64).copy(), np.zeros((shards, len(counts)), np.int64)
    for h in range(shards):
        out[h] = rng.multivariate_hypergeometric(left, int(left.sum()) // (shards - h), method="marginals")
        left -= out[h]
    return out


def mix_sources(
    docs: DataFrame, weights: DataFrame, block_tokens: int = 256, slots_per_shard: int = 4096, seed: int = 1234, lack: str = "spread"
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). docs: doc_id, source, tokens. weights: source, target_share, max_repeats.

    Each source's documents, in hashed order, form one stream of tokens that is cut into blocks of
    block_tokens (the last may be shorter). The output has as many places as the tokens of the
    weighted sources fill blocks, as far as the sources can fill them. `fill` says what each source
    should give, `lack` what happens where a source cannot give its share. The driver draws the counts
    of at most MAX_PLAN_ROWS / sources stretches of places; a stretch deals its counts to shards of
    about slots_per_shard places in a task. The k-th place of a source takes block
    permutation(k mod blocks) of its (k div blocks)-th pass, and places meet blocks in one equi-join
    on (source, block). So no block is used more than max_repeats times, and each pass has its own order.

    mix: shard, source, place, pass, block, doc_id, first_token, n_tokens: the pieces of documents in
    each place. report, one row per source of weights: target_share, tokens (available once),
    capacity (tokens x max_repeats), needed (target_share of all tokens), reached (capacity >= needed),
    aimed_share (after `fill`), used, actual_share (of the mix), deviation (actual less target), and met:
    the mix holds the target share, less three deviations of the draw. A source without documents is
    reported with zeros.

    Documents with a null id, of a null source or of one without a weight take no part; repeated
    doc_ids count once; null or negative tokens count as 0. Of repeated rows of a source in weights
    the first in order counts. At most MAX_SOURCES sources, read by the driver.
    """
    spark = docs.sparkSession
    wanted = (
        weights.filter("source is not null").groupBy("source")
        .agg(F.min(F.struct("target_share", "max_repeats")).alias("w"))
        .select("source", F.coalesce("w.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("w.max_repeats", F.lit(0)).alias("max_repeats"))
        .orderBy("source").limit(MAX_SOURCES + 1).collect()
    )
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(wanted)], "source string, s int")
    one = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r"))
    held = one.select("doc_id", F.col("r.source").alias("source"), F.greatest(F.coalesce("r.tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    held = cut(held.join(F.broadcast(names), "source").select("s", "doc_id", "tokens"))
    totals = {r["s"]: r["t"] for r in held.groupBy("s").agg(F.sum("tokens").alias("t")).collect()}
    tokens = np.array([totals.get(i, 0) for i in range(len(wanted))], np.int64)
    share = np.array([max(0.0, r["target_share"]) for r in wanted], float)
    repeats = np.array([max(0, r["max_repeats"]) for r in wanted], np.int64)
    blocks = -(-tokens // block_tokens)
    slots = int(-(-tokens.sum() // block_tokens))
    aims = fill(share, blocks * repeats, slots, lack)
    shards = max(1, round(-(-float(aims.sum()) // slots_per_shard)))
    stretches = int(max(1, min(shards, MAX_PLAN_ROWS // max(1, len(wanted)))))
    counts = shard_counts(aims, blocks * repeats, stretches, seed)
    first = np.cumsum(counts, axis=0) - counts
    bounds = np.arange(stretches + 1) * shards // stretches
    plan = [(h, int(bounds[h]), int(bounds[h + 1] - bounds[h]), first[h].tolist(), counts[h].tolist()) for h in range(stretches) if counts[h].any()]
    sizes = blocks.tolist()

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, shard, n, start, count in f.itertuples(index=False, name=None):
                dealt = split_counts(np.array(count), n, np.random.default_rng((seed, h)))
                begin = np.array(start) + np.cumsum(dealt, axis=0) - dealt
                i, k = np.nonzero(dealt)
                yield pd.DataFrame({"shard": shard + i, "s": k, "first": begin[i, k], "n": dealt[i, k], "blocks": np.array(sizes, np.int64)[k]})

    dealt = spark.createDataFrame(plan, "h long, shard long, n long, start array<long>, count array<long>")
    places = dealt.mapInPandas(deal, "shard long, s int, first long, n long, blocks long")
    places = places.select("shard", "s", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("place"))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                n, size = f["place"].to_numpy(), f["blocks"].to_numpy()
                turn = n // size
                block = permute(n % size, size, (f["s"].to_numpy().astype(np.int64) + 1) * 1_000_003 + turn * 7919 + seed)
                yield pd.DataFrame({"shard": f["shard"], "s": f["s"], "place": n, "pass": turn, "block": block})

    places = places.mapInPandas(look_up, "shard long, s int, place long, pass long, block long")
    stream = running_weight(held.filter("tokens > 0"), ["s"], [hash_uniform(seed, F.col("doc_id")), F.col("doc_id")], "tokens", "start")
    size = F.lit(block_tokens)
    pieces = stream.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("tokens") - 1) / size)))
    ).select(
        "s", "block", "doc_id",
        F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("start")).alias("first_token"),
        (F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * size) - F.greatest(F.col("start"), F.col("block") * size)).alias("n_tokens"),
    )
    mix = cut(places.join(pieces, ["s", "block"]))
    used = {r["s"]: r["u"] for r in mix.groupBy("s").agg(F.sum("n_tokens").alias("u")).collect()}
    everything, drawn, aimed = int(tokens.sum()), sum(used.values()), float(aims.sum())
    rows = []
    for i, r in enumerate(wanted):
        capacity, needed, u, w = int(tokens[i] * repeats[i]), float(share[i] * everything), int(used.get(i, 0)), float(share[i])
        actual = u / drawn if drawn else 0.0
        noise = 3 * (max(0.0, w * (1 - w)) / max(1.0, aimed)) ** 0.5 + 2 / max(1.0, aimed)
        rows.append((r["source"], w, int(repeats[i]), int(tokens[i]), capacity, needed, capacity >= needed, float(aims[i] / aimed) if aimed else 0.0, u, actual, actual - w, actual >= w - noise))
    report = spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, tokens long, capacity long, needed double, reached boolean, aimed_share double, used long, actual_share double, deviation double, met boolean",
    )
    return mix.join(F.broadcast(names), "s").select("shard", "source", "place", "pass", "block", "doc_id", "first_token", "n_tokens"), report
