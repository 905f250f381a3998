"""Forward-push personalised PageRank: the depth-bounded queue, replayed for each query over its own part of the graph."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.operators.grouped import each_query
from trellium.operators.traverse import bfs


def push(mass: list[tuple[int, float]], out: dict[int, list[int]], hops: int, alpha: float, r_max: float, budget: int) -> tuple[dict[int, float], int, bool]:
    """(reserve by vertex, edges taken, censored) of seeds in their order.

    A queued vertex is served with all it has got by then; deeper than `hops` nothing is passed on. Where the budget
    ends inside a vertex, its mass is split among the edges taken.
    """
    reserve: dict[int, float] = {}
    residue: dict[int, float] = defaultdict(float)
    queue: deque[tuple[int, int]] = deque()
    steps, censored = 0, False
    for v, p in mass:
        reserve.setdefault(v, 0.0)
        residue[v] += p
        if residue[v] >= r_max:
            queue.append((v, 0))
    while queue:
        v, depth = queue.popleft()
        held = residue[v]
        if held < r_max:
            continue
        reserve[v] = reserve.get(v, 0.0) + alpha * held
        residue[v] = 0.0
        if depth >= hops:
            continue
        if steps >= budget:
            censored = True
            continue
        targets = out.get(v, [])
        taken = targets[: budget - steps]
        steps += len(taken)
        censored |= steps >= budget
        for w in taken:
            reserve.setdefault(w, 0.0)
            residue[w] += (1 - alpha) * held / len(taken)
            if residue[w] >= r_max:
                queue.append((w, depth + 1))
    return reserve, steps, censored


def push_by_residue(mass: list[tuple[int, float]], out: dict[int, list[int]], alpha: float, r_max: float) -> dict[int, float]:
    """Reserves with the largest residue served first and no bound of depth, until none exceeds r_max."""
    reserve: dict[int, float] = defaultdict(float)
    residue: dict[int, float] = defaultdict(float)
    for v, p in mass:
        residue[v] += p
    heap = [(-r, v) for v, r in residue.items()]
    heapq.heapify(heap)
    while heap:
        r, v = heapq.heappop(heap)
        held = residue[v]
        if -r != held or held <= r_max:
            continue
        reserve[v] += alpha * held
        residue[v] = 0.0
        for w in out.get(v, []):
            residue[w] += (1 - alpha) * held / len(out[v])
            heapq.heappush(heap, (-residue[w], w))
    return dict(reserve)


def reserves(seeds: DataFrame, edges: DataFrame, hops: int, alpha: float, r_max: float, budget: int) -> DataFrame:
    """(qid, vid, reserve, steps, censored) of seeds(qid, vid, dist, ord): mass by 1 / (1 + dist); every touched vertex is listed.

    Each query gets only the edges out of what it reaches in fewer than `hops` hops.
    """
    starts = seeds.select("qid", F.col("vid").alias("seed"))
    near = starts.select("qid", F.col("seed").alias("vid")).unionAll(bfs(edges, starts, hops - 1).select("qid", "vid")) if hops else starts.select("qid", F.col("seed").alias("vid")).limit(0)
    part = near.distinct().join(edges.select("src", "dst", "seq"), F.col("vid") == F.col("src"))
    none = F.lit(None).cast("double")
    rows = seeds.select("qid", F.lit(0).alias("kind"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("vid").alias("v"), F.col("dist").cast("double").alias("x"))
    rows = rows.unionByName(part.select("qid", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("seq").cast("long").alias("b"), F.col("dst").alias("v"), none.alias("x")))

    def run(qid: int, cols: list[list]) -> list[tuple]:
        mass: list[tuple[int, float]] = []
        out: dict[int, list[int]] = defaultdict(list)
        for kind, a, _, v, x in zip(*cols, strict=True):
            if kind:
                out[a].append(v)
            else:
                mass.append((v, 1.0 / (1.0 + x)))
        total = np.array([w for _, w in mass]).sum()
        got, steps, censored = push([(v, w / total) for v, w in mass], out, hops, alpha, r_max, budget)
        return [(qid, v, r, steps, censored) for v, r in got.items()]

    return each_query(rows, ["kind", "a", "b", "v"], run, "qid long, vid long, reserve double, steps long, censored boolean")
