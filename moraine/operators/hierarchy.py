"""Parent-child rows to full hierarchies by heavy-path decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.graph import climb
from moraine.operators.ranking import running_weight
from moraine.session import cut


def cycle_members(endless: DataFrame) -> DataFrame:
    """The nodes lying on a cycle, from nodes (node, ptr) all of which lead into one.

    The image of the repeated jump shrinks until it holds the cycles alone, where it is a permutation.
    """
    step = cut(endless.select("node", "ptr"))
    image, before = step.select(F.col("ptr").alias("node")).distinct(), -1
    while (now := image.count()) != before:
        before = now
        step = cut(step.join(step.select(F.col("node").alias("ptr"), F.col("ptr").alias("_next")), "ptr").select("node", F.col("_next").alias("ptr")))
        image = step.select(F.col("ptr").alias("node")).distinct()
    return image


def heavy_paths(rows: DataFrame, paths: bool = True) -> DataFrame:
    """Full hierarchy of rows (node long, parent long).

    Output, one row per distinct non-null node: node, root, depth, path (array from the root to the
    node), chain (head of its heavy chain), position (in the chain), first, last (the node's
    descendants are the nodes of the same root with first < their `first` <= last), n_descendants,
    state ('root', 'child', 'cycle' for nodes on a cycle, 'stray' for nodes that lead into one).

    A parent that is null or not held makes a root. Of several rows of one node the one with the
    smallest non-null parent counts. For 'cycle' and 'stray' nodes root, depth, path and interval are
    null. An empty input gives an empty output; further columns are ignored. With paths=False the
    column path is left out, and with it every array: the cost no longer depends on the lengths of chains.

    Cycles are separated first, by doubling, which also counts subtrees. The child with the largest
    subtree continues its parent's chain, so any path crosses at most log2(n) chains; heads, path
    prefixes and preorder offsets of chains are composed by doubling over chains. Path arrays are the
    requested output and bound the length of a collected chain.
    """
    held = rows.filter("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    held = cut(held)
    up = held.filter("parent is not null").join(held.select(F.col("node").alias("parent")), "parent", "left_semi")
    linked = held.select("node").join(up.select("node", "parent"), "node", "left")
    reached, endless = climb(linked.select("node", F.col("parent").alias("ptr")), sizes=True)

    on_cycle = cycle_members(endless).withColumn("_on", F.lit(True))
    lost = endless.select("node").join(on_cycle, "node", "left").select(
        "node", F.when(F.col("_on"), "cycle").otherwise("stray").alias("state")
    )

    tree = cut(reached.select("node", "hops", "size").join(up.select("node", "parent"), "node", "left"))
    child = tree.filter("parent is not null").select("node", "parent", "size")
    heavy = child.groupBy("parent").agg(
        F.max(F.struct("size", (-F.col("node")).alias("minus"))).alias("top")
    ).select("parent", (-F.col("top.minus")).alias("heavy"), F.col("top.size").alias("heavy_size"))
    child = cut(child.join(heavy, "parent"))

    # chains: climb along heavy links only
    ladder = tree.select("node").join(
        child.filter("node = heavy").select("node", F.col("parent").alias("ptr")), "node", "left"
    )
    placed, _ = climb(ladder)
    placed = cut(placed.select("node", F.col("far").alias("chain"), F.col("hops").alias("position")))
    none = F.array().cast("array<long>")
    # a light child starts a chain: where it hangs, and how far its preorder number is from its upper chain's head
    light = running_weight(child.filter("node <> heavy"), ["parent"], [F.col("node")], "size", "_earlier")
    hang = light.join(placed.select(F.col("node").alias("parent"), F.col("chain").alias("ptr"), "position"), "parent").select(
        "node", "ptr", "position", (F.col("position") + 1).alias("length"), (F.col("position") + 1 + F.col("heavy_size") + F.col("_earlier")).alias("shift")
    )
    if paths:
        members = placed.groupBy("chain").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))), lambda s: s["node"]).alias("members")
        )
        hang = hang.join(members.withColumnRenamed("chain", "ptr"), "ptr").withColumn("prefix", F.slice("members", 1, F.col("length").cast("int")))
    heads = placed.filter("position = 0").select(F.col("chain").alias("node")).join(hang, "node", "left").select(
        "node", "ptr", F.coalesce("shift", F.lit(0)).cast("long").alias("shift"), F.coalesce("length", F.lit(0)).cast("long").alias("length"),
        *([F.coalesce("prefix", none).alias("prefix")] if paths else []),
    )
    chains, _ = climb(heads, sums=("shift", "length"), lists=("prefix",) if paths else ())
    chains = chains.withColumnsRenamed({"node": "chain", "far": "root"}).drop("hops")
    if paths:
        chains = chains.join(members, "chain")

    full = (
        tree.select("node", "size", "parent")
        .join(placed, "node")
        .join(chains, "chain")
        .select(
            "node",
            "root",
            (F.col("length") + F.col("position")).cast("int").alias("depth"),
            *([F.concat("prefix", F.slice("members", 1, (F.col("position") + 1).cast("int"))).alias("path")] if paths else []),
            "chain",
            F.col("position").cast("int").alias("position"),
            (F.col("shift") + F.col("position")).alias("first"),
            (F.col("shift") + F.col("position") + F.col("size") - 1).alias("last"),
            (F.col("size") - 1).alias("n_descendants"),
            F.when(F.col("parent").isNull(), "root").otherwise("child").alias("state"),
        )
    )
    return full.unionByName(lost, allowMissingColumns=True)


def descendants(full: DataFrame) -> DataFrame:
    """Rows (node, descendant) of a result of heavy_paths, one for each node below another.

    Taken from the paths: as many rows as the sum of all depths, and no group is gathered.
    """
    return full.filter("state = 'child'").select(
        F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"), F.col("node").alias("descendant")
    )
