"""Least travel times to wanted nodes nearby: sources that lie together share the piece of the network around them.

Sources are dealt into blocks by their ids, and each is searched inside its block's piece of the network. A search that ends before the piece
does is final. Pieces are first the edges that leave a range of ids; for sources whose way leads out of it (all of them, where ids have no order)
they grow by joins, an edge further each time. An edge is sent to a block once, however many of its sources pass it, and labels are never
shuffled: what is, grows as the edges, not as sources times nodes reached. Pieces are bounded: what does not end in them is handed back.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wattroute.operators.rounds import durable

RANGE, BLOCK = 1024, 64  # ids in a block of the first search, whose piece has half as many more on both sides; in a block of the others
HOPS = (6, 6, 12)  # edges by which pieces grow before each of the others
WAYS, PAIRS, LABELS = 100_000, 100_000, 500_000  # most edges of a piece, most wanted pairs of a block, labels after which a block begins no other source: what one task holds


def _searcher(most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What searches a block: the labels of its sources that are final, and the pairs of the others as they came."""

    def costs_of(source: int, wanted: set, ahead: dict) -> dict | None:
        """Least costs up to the last wanted node; None if a node is passed whose edges the piece lacks."""
        least, done, queue, left = {source: 0.0}, {}, [(0.0, source)], set(wanted)
        while queue:
            cost, node = heapq.heappop(queue)
            if node in done:
                continue
            done[node] = cost
            left.discard(node)
            if not left:
                break
            if node not in ahead:
                return None
            for to, w in ahead[node]:
                if cost + w < least.get(to, math.inf):
                    least[to] = cost + w
                    heapq.heappush(queue, (cost + w, to))
        return done

    def on_the_way(costs: dict, wanted: set, before: dict) -> set:
        """The wanted nodes that were reached and the nodes of all their best ways."""
        found, todo = set(), [n for n in wanted if n in costs]
        while todo:
            if (node := todo.pop()) not in found:
                found.add(node)
                todo += [a for a, w in before.get(node, ()) if a in costs and abs(costs[a] + w - costs[node]) <= 1e-9]
        return found

    def run(wanted: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        ahead, before, wants, rows = {}, {}, {}, []
        for a, b, w in zip(ways["src"].tolist(), ways["dst"].tolist(), ways["w"].tolist(), strict=True):
            ahead.setdefault(a, []).append((b, w))
            before.setdefault(b, []).append((a, w))
        for block, source, node in zip(wanted["block"].tolist(), wanted["source"].tolist(), wanted["node"].tolist(), strict=True):
            wants.setdefault((block, source), set()).add(node)
        for (block, source), nodes in wants.items():
            costs = costs_of(source, nodes, ahead) if len(rows) < most else None
            if costs is None:
                rows += [(block, source, n, 0.0, True) for n in nodes]
            else:
                rows += [(block, source, n, costs[n], False) for n in on_the_way(costs, nodes, before)]
        return pd.DataFrame(rows, columns=["block", "source", "node", "cost_s", "open"])

    return run


def _whole(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, IntegralType)


def _dealt(pairs: DataFrame, ids: int) -> DataFrame:
    return pairs.select((F.floor(F.col("source") / ids) if _whole(pairs, "source") else F.xxhash64("source")).alias("block"), "source", "node")


def _above(rows: DataFrame, most: int) -> DataFrame:
    """The blocks of more rows than one task should hold."""
    return rows.groupBy("block").count().where(F.col("count") > most).select("block")


def _search(pairs: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final labels, pairs still open) of pairs(block, source, node) in the pieces ways(block, src, dst, w)."""
    full = durable(_above(ways, WAYS).union(_above(pairs, PAIRS)).distinct())
    fit = [df.join(full, "block", "left_anti").groupBy("block") for df in (pairs, ways)]
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in pairs.columns) + ", cost_s double, open boolean"
    found = durable(fit[0].cogroup(fit[1]).applyInPandas(_searcher(LABELS), schema))
    still = found.where("open").unionByName(pairs.join(full, "block", "left_semi"), allowMissingColumns=True)
    return found.where("not open").select("source", "node", "cost_s"), still.select("source", "node")


def _leaving(rim: DataFrame, weights: DataFrame) -> DataFrame:
    """The edges from the nodes on the rim of each piece; each node also gets one to itself, so that it counts as known if none leaves it."""
    out = rim.join(weights, F.col("node") == F.col("src")).select("block", "src", "dst", "w")
    return durable(out.unionByName(rim.select("block", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w"))))


def search(weights: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, node, cost_s; pairs left over): a source's wanted nodes, where a way leads there, and all nodes of their best ways; or all its pairs as they came.

    weights(src, dst, w): one edge for a pair of nodes. wanted(source, node): distinct pairs. Both are tables that were written.
    """
    labels, todo = [wanted.select("source", "node", F.lit(0.0).alias("cost_s")).where("false")], wanted
    if _whole(weights, "src") and _whole(wanted, "source"):
        ranges = F.sequence(F.floor((F.col("src") - RANGE // 2) / RANGE), F.floor((F.col("src") + RANGE // 2) / RANGE))
        found, todo = _search(_dealt(wanted, RANGE), weights.select(F.explode(ranges).alias("block"), "src", "dst", "w"))
        labels.append(found)
    n, pairs, ways = todo.count(), durable(_dealt(todo, BLOCK)), []
    rim = seen = durable(pairs.select("block", F.col("source").alias("node")).distinct())
    for hops in HOPS:
        if n == 0:
            break
        for _ in range(hops):
            ways.append(_leaving(rim, weights))
            ahead = ways[-1].select("block", F.col("dst").alias("node")).distinct().join(seen, ["block", "node"], "left_anti")
            rim = durable(ahead.join(_above(reduce(DataFrame.unionByName, ways), WAYS), "block", "left_anti"))
            seen = seen.unionByName(rim)
            if rim.isEmpty():
                break
        found, todo = _search(pairs, reduce(DataFrame.unionByName, ways))
        labels.append(found)
        before, n, pairs = n, todo.count(), durable(_dealt(todo, BLOCK))
        if n > 0.9 * before:  # what is far does not end in somewhat larger pieces either
            break
        blocks = durable(pairs.select("block").distinct())
        rim, seen, *ways = (df.join(blocks, "block", "left_semi") for df in (rim, seen, *ways))
    return reduce(DataFrame.unionByName, labels), pairs.select("source", "node")
