"""Connected components of a graph of pairs, and choices in an order that are made in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import stored


def components(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., node, component) of ``pairs(groups..., a, b)``: the least node that each node reaches.

    Each round takes the least label among the neighbours, then that label's own label, so that rounds
    grow with the logarithm of the longest path; labels are written to the shared folder.
    """
    g = [F.col(c) for c in groups]
    both = stored(pairs.select(*g, "a", "b").union(pairs.select(*g, "b", "a")).distinct(), "pairs")
    labels = stored(both.groupBy(*g, F.col("a").alias("node")).agg(F.min("b").alias("m")).select(*g, "node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*groups, "b"]).groupBy(*g, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, [*groups, "node"]).select(*g, "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(*g, F.col("node").alias("component"), F.col("component").alias("far"))
        low = F.least("component", "far")
        new = stored(step.join(jump, [*groups, "component"]).select(*g, "node", low.alias("component"), (low != F.col("old")).alias("moved")), "labels")
        labels = new.select(*g, "node", "component")
        if not new.filter("moved").limit(1).count():
            return labels


#: Rounds after which clumps of at most so many pairs are decided each in one task.
FIRST_ROUNDS, CLUMP_PAIRS = 3, 1 << 20


def _in_order(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """`first_choices` of whole components, each by its sorted pairs, which pass in batches: a task keeps what one component has taken."""
    keys = [*groups, "component"]
    kinds = dict(pairs.dtypes)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken, done = None, set(), None
        for f in batches:
            keep = []
            for k, (key, a, b) in enumerate(zip(f[keys].itertuples(index=False, name=None), f["a"].tolist(), f["b"].tolist(), strict=True)):
                if key != at:
                    at, taken, done = key, set(), None
                if b != done and a not in taken:
                    taken.add(a)
                    done = b
                    keep.append(k)
            yield f.iloc[keep][[*groups, "a", "b"]]

    return pairs.repartition(*keys).sortWithinPartitions(*keys, "b", "a").mapInPandas(take, ", ".join(f"{c} {kinds[c]}" for c in [*groups, "a", "b"]))


def first_choices(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., a, b) of ``pairs(groups..., a, b)``: in the order of b, each b takes the smallest a that is left.

    By deferred acceptance: every b asks its smallest a; an a that several ask keeps the smallest b, for all
    a have this one preference, and the refused ask the next. No b can lose what it would have had in order, so the
    result is the same. A round costs a few joins of the refused. A chain or a star of any length takes one or two
    rounds; a clump in which each is paired with each takes as many as it has members, so after FIRST_ROUNDS
    clumps of up to CLUMP_PAIRS pairs are decided in memory, each in a task, and only larger ones go on by rounds.
    """
    pairs = stored(pairs.select(*groups, "a", "b"), "pairs")
    asks, turn, decided = stored(pairs.groupBy(*groups, "b").agg(F.min("a").alias("a")), "asks"), 0, None
    while True:
        best = asks.groupBy(*groups, "a").agg(F.min("b").alias("_won"))
        judged = stored(asks.join(best, [*groups, "a"]).select(*groups, "a", "b", (F.col("b") != F.col("_won")).alias("_lost")), "judged")
        lost = judged.filter("_lost").select(*groups, "b", F.col("a").alias("_tried"))
        if not lost.limit(1).count():
            out = judged.select(*groups, "a", "b")
            return out if decided is None else out.union(decided)
        turn += 1
        if turn == FIRST_ROUNDS:
            marked = stored(pairs.join(components(pairs, groups).withColumnRenamed("node", "a"), [*groups, "a"]), "clumps")
            sizes = marked.groupBy(*groups, "component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= CLUMP_PAIRS)
            stuck = marked.join(lost, [*groups, "b"], "left_semi").select(*groups, "component").distinct().join(sizes, [*groups, "component"])
            small = stored(marked.join(stuck.select(*groups, "component"), [*groups, "component"], "left_semi"), "small-clumps")
            decided = stored(_in_order(small, groups), "in-order")
            judged = stored(judged.join(small.select(*groups, "b").distinct(), [*groups, "b"], "left_anti").select(*groups, "a", "b", "_lost"), "judged")
            lost = judged.filter("_lost").select(*groups, "b", F.col("a").alias("_tried"))
        more = pairs.join(lost, [*groups, "b"]).filter("a > _tried").groupBy(*groups, "b").agg(F.min("a").alias("a"))
        asks = stored(judged.filter("not _lost").select(*groups, "b", "a").union(more.select(*groups, "b", "a")), "asks")


def first_independent(nodes: DataFrame, edges: DataFrame, group: str, side: float) -> DataFrame:
    """(group, node, chosen): in the order of node, which are reached by no chosen smaller neighbour; chosen are those of them that are ``able``.

    nodes: (group, node, x, y, able); edges: (group, a, b), b < a, the two at most ``side`` / 2 apart. By a wavefront: the plane is cut in
    squares of ``side`` and each square, in memory, decides its nodes in order as far as its smaller neighbours
    outside are decided. The next round cuts it half a side further along, so that what waited on both sides of a
    border lies inside one square. All squares of all groups work at once; a task holds the open nodes of one
    square. Rounds grow with the squares that a series of dependent nodes crosses, not with the nodes.
    """
    kinds = dict(nodes.dtypes)
    waiting = edges.groupBy(group, F.col("a").alias("node")).agg(F.collect_list("b").alias("before"))
    open_ = stored(nodes.join(waiting, [group, "node"], "left").withColumn("before", F.coalesce("before", F.array().cast(f"array<{kinds['node']}>"))), "open")
    done: list[DataFrame] = []
    turn = 0

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fate = None, {}
        for f in batches:
            out = []
            for g, cx, cy, node, able, before in zip(f[group], f["_cx"], f["_cy"], f["node"], f["able"], f["before"], strict=True):
                if at != (g, cx, cy):
                    at, fate = (g, cx, cy), {}
                # True: chosen; False: reached, or not able; missing: open.
                known = [fate.get(b) for b in before]
                if any(known):
                    fate[node] = free = False
                elif None in known:
                    continue
                else:
                    fate[node], free = bool(able), True
                out.append((g, node, free, fate[node]))
            yield pd.DataFrame(out, columns=[group, "node", "free", "chosen"])

    while True:
        dx, dy = (turn % 2) * side / 2, (turn // 2 % 2) * side / 2
        placed = open_.withColumns({"_cx": F.floor((F.col("x") + dx) / side), "_cy": F.floor((F.col("y") + dy) / side)})
        fates = stored(placed.repartition(group, "_cx", "_cy").sortWithinPartitions(group, "_cx", "_cy", "node").mapInPandas(decide, f"{group} {kinds[group]}, node {kinds['node']}, free boolean, chosen boolean"), "fates")
        done.append(fates)
        rest = open_.join(fates.select(group, "node"), [group, "node"], "left_anti")
        # What is left learns the fates of its smaller neighbours: one that is chosen reaches it, the others no longer count.
        told = rest.select(group, "node", F.explode_outer("before").alias("b")).join(fates.select(group, F.col("node").alias("b"), "chosen"), [group, "b"], "left")
        told = told.groupBy(group, "node").agg(F.coalesce(F.bool_or("chosen"), F.lit(False)).alias("_reached"), F.collect_list(F.when(F.col("chosen").isNull(), F.col("b"))).alias("before"))
        told = stored(rest.drop("before").join(told, [group, "node"]), "open")
        hit = told.filter("_reached").select(group, "node", F.lit(False).alias("free"), F.lit(False).alias("chosen"))
        done.append(hit)
        open_, turn = told.filter("not _reached").drop("_reached"), turn + 1
        if not told.limit(1).count():
            break
        # Those that were just reached no longer stand in the way of others.
        if hit.limit(1).count():
            gone = open_.select(group, "node", F.explode_outer("before").alias("b")).join(hit.select(group, F.col("node").alias("b"), F.lit(True).alias("_gone")), [group, "b"], "left")
            before = gone.groupBy(group, "node").agg(F.collect_list(F.when(F.col("_gone").isNull(), F.col("b"))).alias("before"))
            open_ = stored(open_.drop("before").join(before, [group, "node"]), "open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
