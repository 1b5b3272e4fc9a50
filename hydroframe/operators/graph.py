"""Graphs as edge tables: components, flow relations, shares, distances to the outlet, orientation.

Graphs of up to MAX_HELD edges (counted) are held by the tasks: flow is solved by one call, and what lies around a
start is searched for all starts in parallel, in one job. Larger graphs are worked through level by level with joins
and checkpoints until nothing is left to do. Both ways give the same.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.plans.io import cut

#: Edges of a graph that tasks hold as a whole (some 20 MB).
MAX_HELD = 200_000

Around = dict[object, list[tuple[object, float, float]]]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the least node of each connected component; checkpointed minimum propagation until
    nothing changes. Every round also jumps to what the found node has found, so rounds grow with the logarithm of
    the diameter."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    state = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        offer = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("component").alias("offered"))
        step = state.join(offer, state["node"] == offer["a"], "left").select("node", "component", F.least("component", F.coalesce("offered", "component")).alias("new"))
        hop = step.select(F.col("node").alias("via"), F.col("new").alias("hopped"))
        step = cut(step.join(hop, step["new"] == hop["via"], "left").select("node", "component", F.least("new", "hopped").alias("new")))
        if step.where("new <> component").isEmpty():
            return state
        state = step.select("node", F.col("new").alias("component"))


def held(edges: DataFrame, here: str, there: str, *, weight: str | None = None) -> Broadcast | None:
    """{node: [(next node, length, factor)]} of a graph of at most MAX_HELD edges, for all tasks; None beyond."""
    rows = edges.select(here, there, "length", F.col(weight).alias("w") if weight else F.lit(1.0).alias("w")).limit(MAX_HELD + 1).toArrow().to_pydict()
    if len(rows["w"]) > MAX_HELD:
        return None
    around: Around = defaultdict(list)
    for a, b, length, w in zip(rows[here], rows[there], rows["length"], rows["w"]):
        around[a].append((b, length, w))
    return edges.sparkSession.sparkContext.broadcast(dict(around))


def _solve_flow(f: pd.DataFrame) -> pd.DataFrame:
    """Flow of all edges of a held graph, in topological order."""
    f = f.sort_values("edge").reset_index(drop=True)
    waiting, out, total = defaultdict(int), defaultdict(list), defaultdict(float)
    for i, (up, down) in enumerate(zip(f["up"], f["down"])):
        waiting[down] += 1
        out[up].append(i)
    ready = [n for n in out if not waiting[n]]
    flow = [0.0] * len(f)
    down, split = f["down"].tolist(), f["split"].tolist()
    heads, done = set(ready), 0
    while ready:
        n = ready.pop()
        for i in out[n]:
            flow[i] = (1.0 if n in heads else total[n]) * split[i]
            total[down[i]] += flow[i]
            waiting[down[i]] -= 1
            done += 1
            if not waiting[down[i]]:
                ready.append(down[i])
    if done < len(f):
        raise ValueError("the graph has a cycle")
    return f.assign(flow=flow)[["edge", "up", "down", "length", "flow"]]


def _flow_by_level(todo: DataFrame) -> DataFrame:
    """Flow of all edges, level by level; levels stay separate checkpoints and are united once."""
    levels: list[DataFrame] = []
    inflow = None
    while not todo.isEmpty():
        blocked = todo.select(F.col("down").alias("up")).distinct()
        ready = todo.join(blocked, "up", "left_anti")
        ready = ready.withColumn("inflow", F.lit(None).cast("double")) if inflow is None else ready.join(inflow, "up", "left")
        level = cut(ready.withColumn("flow", F.coalesce("inflow", F.lit(1.0)) * F.col("split")).select("edge", "up", "down", "length", "flow"))
        if level.isEmpty():
            raise ValueError("the graph has a cycle")
        levels.append(level)
        new = level.groupBy(F.col("down").alias("up")).agg(F.sum("flow").alias("inflow"))
        # Only nodes that still have edges to feed are carried on.
        todo = cut(todo.join(level.select("edge"), "edge", "left_anti"))
        new = new if inflow is None else inflow.unionByName(new).groupBy("up").agg(F.sum("inflow").alias("inflow"))
        inflow = cut(new.join(todo.select("up").distinct(), "up", "left_semi"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def flow_shares(edges: DataFrame) -> DataFrame:
    """edges (edge, up, down, length, weight null or positive) with flow and share.

    Water divides at a split by weight where all are known, else equally; headwaters carry one unit; a share is an
    edge's part of what enters its lower node. A cycle is refused.
    """
    out = W.partitionBy("up")
    known = F.min(F.coalesce((F.col("weight") > 0).cast("int"), F.lit(0))).over(out) == 1
    split = F.when(known, F.col("weight") / F.sum("weight").over(out)).otherwise(1 / F.count(F.lit(1)).over(out))
    todo = cut(edges.withColumn("split", split).select("edge", "up", "down", "length", "split"))
    n = todo.count()
    if n == 0:
        flows = todo.select("edge", "up", "down", "length", F.lit(1.0).alias("flow"))
    elif n <= MAX_HELD:
        kinds = dict(todo.dtypes)
        flows = todo.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: _solve_flow(f), ", ".join(f"{c} {kinds[c]}" for c in ("edge", "up", "down", "length")) + ", flow double")
    else:
        flows = _flow_by_level(todo)
    into = W.partitionBy("down")
    return flows.withColumn("share", F.col("flow") / F.sum("flow").over(into))


def _search(around: Around, start: list[tuple[object, float, float]], limit: float) -> dict[object, tuple[float, float]]:
    """{node: (least distance, sum of the shares over paths)} within limit of a start's nodes (node, distance, share).

    Distances first; shares then flow over the reached nodes only, a node passing its share on once all reached edges
    into it have brought theirs.
    """
    best: dict[object, float] = {}
    heap = [(d, k, n) for k, (n, d, _) in enumerate(start) if d <= limit]
    for d, _, n in heap:
        best[n] = min(d, best.get(n, d))
    heapq.heapify(heap)
    k = len(start)
    while heap:
        d, _, n = heapq.heappop(heap)
        if d > best[n]:
            continue
        for m, length, _ in around.get(n, ()):
            if (x := d + length) <= limit and x < best.get(m, float("inf")):
                best[m] = x
                k += 1
                heapq.heappush(heap, (x, k, m))
    waiting: dict[object, int] = defaultdict(int)
    for n in best:
        for m, _, _ in around.get(n, ()):
            if m in best:
                waiting[m] += 1
    share: dict[object, float] = defaultdict(float)
    for n, _, s in start:
        if n in best:
            share[n] += s
    ready, done = [n for n in best if not waiting[n]], 0
    while ready:
        n = ready.pop()
        done += 1
        for m, _, factor in around.get(n, ()):
            if m in best:
                share[m] += share[n] * factor
                waiting[m] -= 1
                if not waiting[m]:
                    ready.append(m)
    if done < len(best):
        raise ValueError("the graph has a cycle")
    return {n: (d, share[n]) for n, d in best.items()}


def reach(edges: DataFrame, starts: DataFrame, limit: float, towards: str = "down") -> DataFrame:
    """(station, node, distance, share) of the nodes within the limit of each start, downstream or upstream.

    starts: station, node, distance, share. The distance is the least over paths, the share their sum; a share is
    multiplied by that of every edge it passes. A cycle is refused.
    """
    if towards not in ("down", "up"):
        raise ValueError("towards is down or up")
    here, there = ("up", "down") if towards == "down" else ("down", "up")
    kinds = dict(starts.dtypes)
    graph = held(edges, here, there, weight="share")
    if graph is None:
        return _reach_by_level(edges, starts, limit, here, there)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, n, d, x) for s, begun in zip(f["station"], f["starts"]) for n, (d, x) in _search(graph.value, [(b["node"], b["distance"], b["share"]) for b in begun], limit).items()]
            yield pd.DataFrame(rows, columns=["station", "node", "distance", "share"])

    one = starts.groupBy("station").agg(F.collect_list(F.struct("node", "distance", "share")).alias("starts"))
    # By number, so that small tables aren't merged into few tasks.
    spread = one.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "station")
    return spread.mapInPandas(run, f"station {kinds['station']}, node {kinds['node']}, distance double, share double")


def _reach_by_level(edges: DataFrame, starts: DataFrame, limit: float, here: str, there: str) -> DataFrame:
    way = cut(edges.select(F.col(here).alias("node"), F.col(there).alias("next"), "length", F.col("share").alias("factor")))
    best = cut(starts.where(F.col("distance") <= limit).groupBy("station", "node").agg(F.min("distance").alias("distance")))
    front = best
    while not front.isEmpty():
        offer = front.join(way, "node").where(F.col("distance") + F.col("length") <= limit).groupBy("station", F.col("next").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("offered"))
        front = cut(offer.join(best, ["station", "node"], "left").where("distance IS NULL OR offered < distance - 1e-9").select("station", "node", F.col("offered").alias("distance")))
        best = cut(best.unionByName(front).groupBy("station", "node").agg(F.min("distance").alias("distance")))
    nodes = best.select("station", "node")
    flow = cut(starts.join(nodes, ["station", "node"], "left_semi").groupBy("station", "node").agg(F.sum("share").alias("share")))
    total, rounds = [flow], best.select("node").distinct().count()
    while not flow.isEmpty():
        if len(total) > rounds + 1:  # no path is longer than the nodes are many
            raise ValueError("the graph has a cycle")
        step = flow.join(way, "node").groupBy("station", F.col("next").alias("node")).agg(F.sum(F.col("share") * F.col("factor")).alias("share"))
        flow = cut(step.join(nodes, ["station", "node"], "left_semi"))
        total.append(flow)
    sums = total[0]
    for t in total[1:]:
        sums = sums.unionByName(t)
    return best.join(sums.groupBy("station", "node").agg(F.sum("share").alias("share")), ["station", "node"])


def downstream(edges: DataFrame, starts: DataFrame, limit: float) -> DataFrame:
    """(start, node, distance, share): nodes reached downstream of start nodes within limit, of any number of edges."""
    r = reach(edges, starts.select(F.col("node").alias("station"), "node", F.lit(0.0).alias("distance"), F.lit(1.0).alias("share")), limit)
    return r.withColumnRenamed("station", "start")


def relations(edges: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """(target, station, relation, distance, share): DOWN where the target lies downstream of the station, UP else."""
    d = downstream(edges, nodes, limit).where("start <> node")
    both = F.inline(F.array(F.struct(F.col("node").alias("target"), F.col("start").alias("station"), F.lit("DOWN").alias("relation")), F.struct(F.col("start").alias("target"), F.col("node").alias("station"), F.lit("UP").alias("relation"))))
    return d.select("distance", "share", both).select("target", "station", "relation", "distance", "share")


def outlet_distance(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """(node, distance): the least way along the edges, in either direction, to any outlet."""
    ways = cut(edges.select(F.col("up").alias("a"), F.col("down").alias("b"), "length").unionByName(edges.select(F.col("down").alias("a"), F.col("up").alias("b"), "length")))
    if ways.limit(MAX_HELD + 1).count() <= MAX_HELD:
        begun = outlets.select("node").distinct().select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("length"), F.lit(True).alias("begin"))

        def solve(f: pd.DataFrame) -> pd.DataFrame:
            around: Around = defaultdict(list)
            heap = []
            for a, b, length, begin in zip(f["a"], f["b"], f["length"], f["begin"]):
                if begin:
                    heap.append((0.0, len(heap), b))
                else:
                    around[a].append((b, length, 1.0))
            best, k = {}, len(heap)
            while heap:
                d, _, n = heapq.heappop(heap)
                if n in best:
                    continue
                best[n] = d
                for m, length, _ in around.get(n, ()):
                    if m not in best:
                        k += 1
                        heapq.heappush(heap, (d + length, k, m))
            return pd.DataFrame({"node": list(best), "distance": list(best.values())})

        return ways.withColumn("begin", F.lit(False)).unionByName(begun).groupBy(F.lit(0).alias("all")).applyInPandas(solve, f"node {dict(ways.dtypes)['a']}, distance double")
    best = cut(outlets.select("node", F.lit(0.0).alias("distance")).distinct())
    front = best
    while not front.isEmpty():
        offer = front.join(ways, front["node"] == ways["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("offered"))
        front = cut(offer.join(best, "node", "left").where("distance IS NULL OR offered < distance - 1e-9").select("node", F.col("offered").alias("distance")))
        best = cut(best.unionByName(front).groupBy("node").agg(F.min("distance").alias("distance")))
    return best


def orient(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """Edges turned to run towards the nearest outlet; equally near ends run to the lesser node. Canals keep theirs."""
    d = cut(outlet_distance(edges, outlets))
    e = edges.join(d.select(F.col("node").alias("up"), F.col("distance").alias("du")), "up", "left").join(d.select(F.col("node").alias("down"), F.col("distance").alias("dd")), "down", "left")
    turn = ~F.coalesce(F.col("canal"), F.lit(False)) & ((F.col("du") < F.col("dd")) | ((F.col("du") == F.col("dd")) & (F.col("up") < F.col("down"))))
    turn = F.coalesce(turn, F.lit(False))
    return e.select("edge", F.when(turn, F.col("down")).otherwise(F.col("up")).alias("up"), F.when(turn, F.col("up")).otherwise(F.col("down")).alias("down"), "length", "canal")
