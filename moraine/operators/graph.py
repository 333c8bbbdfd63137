"""Connected components and pointer climbing by doubling, as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.session import cut, release


def flatten(hooks: DataFrame) -> DataFrame:
    """Hooks (x, to), x unique and to < x, with `to` moved on to the end of its chain, by pointer jumping."""
    hooks = cut(hooks)
    while True:
        jump = hooks.select(F.col("x").alias("to"), F.col("to").alias("_far"))
        moved = cut(hooks.join(jump, "to", "left").select("x", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved")))
        release(hooks)
        hooks = moved.select("x", "to")
        hooks._moraine_files = moved._moraine_files
        if moved.filter("_moved").isEmpty():
            return hooks


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id of the component of every node of `edges` (a, b): columns node, comp.

    Minimum-label propagation with hooking: each round a label takes the least label next to it, the
    chains of such hooks are followed to their ends by doubling, and edges are rewritten between the
    labels that are left. At least half of the labels of an open component go in a round. Null endpoints, self loops and
    repeated edges are ignored. A hot node only costs partial aggregation and a skew-split join.
    """
    live = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .distinct()
    )
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(nodes.select("node", F.col("node").alias("comp")))
    for _ in range(max_rounds):
        if live.isEmpty():
            release(live)
            return label
        # every label hooks to the least label next to it
        hook = (
            live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("x"), F.col("e.b").alias("y"))
            .groupBy("x")
            .agg(F.min("y").alias("y"))
            .select("x", F.least("x", "y").alias("to"))
        )
        hook = flatten(hook.filter("x <> to"))
        move = lambda d, c: (
            d.join(hook.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        )
        old = live, label, hook
        live = cut(
            move(move(live, "a"), "b")
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        label = cut(move(label, "comp"))
        release(*old)
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def climb(nodes: DataFrame, sums: tuple[str, ...] = (), lists: tuple[str, ...] = (), sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Follow `ptr` from every `node` to the end of its chain by doubling.

    Input: node (unique), ptr (null at the end of a chain, else a held node), and for every step the
    columns to combine: `sums` are added, `lists` (arrays) are concatenated from the far end on. With
    `sizes`, the number of nodes at or below each node is returned as `size`.
    Output: (reached, endless). reached: node, far (the end), hops, combined columns. endless: node,
    ptr of the nodes whose chain comes back on itself. The number of nodes still climbing after k
    rounds is that of depth 2^k or more; as depths have no gaps, an unchanged number proves that all
    of them are endless.
    """
    extra = [*sums, *lists]
    start = nodes.select(
        "node",
        F.col("ptr").alias("anc"),
        F.coalesce("ptr", "node").alias("far"),
        F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("hops"),
        *extra,
        *([F.lit(1).cast("long").alias("size")] if sizes else []),
    )
    state = cut(start)
    before = -1
    while True:
        active = state.filter("anc is not null")
        now = active.count()
        if now in (0, before):
            break
        before = now
        upper = state.select(
            F.col("node").alias("anc"), F.col("anc").alias("u_anc"), F.col("far").alias("u_far"), F.col("hops").alias("u_hops"),
            *[F.col(c).alias(f"u_{c}") for c in extra],
        )
        moved = active.join(upper, "anc").select(
            "node",
            F.col("u_anc").alias("anc"),
            F.col("u_far").alias("far"),
            (F.col("hops") + F.col("u_hops")).alias("hops"),
            *[(F.col(c) + F.col(f"u_{c}")).alias(c) for c in sums],
            *[F.concat(f"u_{c}", c).alias(c) for c in lists],
            *(["size"] if sizes else []),
        )
        new = moved.unionByName(state.filter("anc is null"))
        if sizes:
            below = active.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("_below"))
            new = new.join(below, "node", "left").withColumn("size", F.col("size") + F.coalesce("_below", F.lit(0))).drop("_below")
        old, state = state, cut(new)
        release(old)
    reached = state.filter("anc is null").drop("anc")
    endless = state.filter("anc is not null").select("node", F.col("anc").alias("ptr"))
    return reached, endless
