"""Components of the members of buckets whose similarity reaches a threshold, every two of a bucket compared or linked.

First a member of each open bucket in turn is compared with the others, which joins large groups cheaply; the rest is
compared pair by pair in cells of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.common import Scratch, few
from marlstone.llm.components import components

#: Members of a block; a task holds the weighted sets of two.
BLOCK = 128


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets; of two empty sets 0."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][ia], b[1][ib]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


def _rest(make_weigh: Callable, threshold: float, kind: pa.DataType):
    """Links among the members of one cell: all pairs of a block, or of two blocks, that are not in one component."""

    def run(cell: pa.Table) -> pa.Table:
        weigh = make_weigh()
        key, crossed = cell.column("key")[0].as_py(), cell.column("i")[0].as_py() != cell.column("j")[0].as_py()
        nodes, owns, keys, block = (cell.column(c).to_pylist() for c in ("node", "component", "keys", "block"))
        sets = [weigh(t) for t in cell.column("item").to_pylist()]
        totals = np.array([s[1].sum() for s in sets])
        every, local = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
        weights, starts = np.concatenate([s[1] for s in sets]), np.cumsum([0, *[len(s[0]) for s in sets]])
        keys, block = [set(k) for k in keys], np.array(block)
        owns = np.unique(owns, return_inverse=True)[1]
        dense, found = np.zeros(len(every)), []
        for x in range(len(sets) - 1):
            own = local[starts[x] : starts[x + 1]]
            dense[own] = sets[x][1]
            at = starts[x + 1]
            shared = np.add.reduceat(np.minimum(dense[local[at:]], weights[at:]), starts[x + 1 : -1] - at)
            dense[own] = 0
            near = shared >= (threshold - 1e-9) * (totals[x] + totals[x + 1 :] - shared)
            near &= owns[x + 1 :] != owns[x]
            if crossed:
                near &= block[x + 1 :] != block[x]
            for y in (np.flatnonzero(near) + x + 1).tolist():
                # A pair that meets in several buckets is tested in that of the least key.
                if owns[x] != owns[y] and min(keys[x] & keys[y]) == key and jaccard(sets[x], sets[y]) >= threshold:
                    found.append((nodes[x], nodes[y]))
                    owns[owns == owns[y]] = owns[x]
        return pa.table([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["a", "b"])

    return run


def _contract(labels: DataFrame, n_labels: int, good: DataFrame, scratch: Scratch) -> DataFrame:
    """The n_labels labels after the components of the linked nodes (a, b) are joined."""
    onto = (
        good.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
        .join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )
    joined = components(onto, scratch)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("onto")), "component", "left")
    out = scratch.save(few(moved.select("node", F.coalesce("onto", "component").alias("component")), n_labels))
    scratch.drop(labels)
    return out


def _open(members: DataFrame, n: int, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (key, node), at most n, of buckets with more than one component, with their component.

    The keys are written before the join, so that AQE can split a hot bucket there.
    """
    placed = scratch.save(few(members.join(labels, "node"), n))
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_keys = scratch.save(few(spread.where("lo <> hi").select("key"), n))
    out = scratch.save(few(placed.join(open_keys, "key"), n))
    scratch.drop(placed)
    return out


def link(members: DataFrame, items: DataFrame, verify: Callable, make_weigh: Callable, threshold: float, rounds: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the members (key, node): each two of a bucket whose similarity reaches the threshold are in one component.

    ``items`` has (node, item); ``verify`` turns (a, b, item_a, item_b) into (a, b, good); ``make_weigh`` gives a task the
    function from an item to its weighted set.
    """
    n = members.count()
    labels = scratch.save(few(members.select("node").distinct(), n).withColumn("component", F.col("node")))
    n_labels = labels.count()
    left, tested = members, None
    for turn in range(rounds):
        waiting = _open(left, n, labels, scratch)
        n = waiting.count()
        if not n:
            return labels
        first = waiting.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("c"))
        chosen = scratch.save(few(first, n))
        pairs = (
            waiting.join(chosen, "key")
            .where("c.component <> component")
            .select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b"), (F.col("c.node") < F.col("node")).alias("c_first"))
            .groupBy("a", "b")
            .agg(F.max("c_first").alias("c_first"))
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # All pairs of a chosen member are settled in its bucket after this turn, so it leaves the bucket.
        left = waiting.join(chosen.select("key", F.col("c.node").alias("node")), ["key", "node"], "left_anti").select("key", "node")
        # The chosen member's item is read once for many pairs that follow each other.
        ordered = pairs.select(F.when(F.col("c_first"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("c_first"), F.col("b")).otherwise(F.col("a")).alias("b"))
        pairs = scratch.save(few(ordered, n))
        if pairs.isEmpty():
            continue
        with_b = pairs.join(items.select(F.col("node").alias("b"), F.col("item").alias("item_b")), "b")
        with_both = with_b.join(items.select(F.col("node").alias("a"), F.col("item").alias("item_a")), "a").select("a", "b", "item_a", "item_b")
        checked = scratch.save(verify(with_both))
        labels = _contract(labels, n_labels, checked.where("good").select("a", "b"), scratch)
        done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = done if tested is None else tested.unionByName(done)
    # The rest exactly: a bucket's members are dealt to blocks, and each two blocks meet in a cell of bounded size.
    waiting = _open(left, n, labels, scratch)
    if waiting.isEmpty():
        return labels
    parts = waiting.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    of_node = members.join(waiting.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
    dealt = waiting.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")).cast("int"))
    cells = dealt.join(of_node, "node").join(items, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "keys", "item")
    kind = members.schema["node"].dataType
    run = _rest(make_weigh, threshold, to_arrow_type(kind))
    found = scratch.save(cells.groupBy("key", "i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}"))
    return _contract(labels, n_labels, found, scratch)
