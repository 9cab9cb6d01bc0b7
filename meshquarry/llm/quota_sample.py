"""Sample matching target category proportions: quotas by min-cost flow, drawn by hash threshold.

The records are counted by category and stage (cells). A min-cost flow over these
counts fills each category's target: floors and margins are arc bounds, cells are arcs
limited by availability, slack arcs take what can't be met. The network has a node per
category and stage, so its size doesn't grow with the data. The integer cell quotas are
then drawn at random without ordering the records.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.functions.text import category_key, is_success, name_key
from meshquarry.llm.thresholds import hash_rank, take_by_hash
from meshquarry.session import spill

#: The sample is this share of the distinct records.
SAMPLE_SHARE = 0.2
#: Largest number of cells for which the network is solved on the driver.
MAX_CELLS = 100_000
_BIG = 1 << 60


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost; shortest augmenting paths with potentials."""
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, 0]
        cost += [w, -w]
    h = [0] * nodes
    while True:
        dist, by = [_BIG] * nodes, [-1] * nodes
        dist[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for e in head[a]:
                b, nd = to[e], d + cost[e] + h[a] - h[to[e]]
                if cap[e] and nd < dist[b]:
                    dist[b], by[b] = nd, e
                    heapq.heappush(queue, (nd, b))
        if dist[sink] == _BIG:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        h = [x + min(d, dist[sink]) for x, d in zip(h, dist)]
        path, b = [], sink
        while b != source:
            path.append(by[b])
            b = to[by[b] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def quotas(cells: dict[tuple[str, str], int], demand: dict[str, int]) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Quota of each (category, stage) cell and shortfall of each category.

    Each category asks for its ``demand``; a stage's margin is its share of what is available, and exceeding it costs
    a little, so quotas follow the stages where they can; the slack of a category costs most.
    """
    cats, stages = sorted(demand), sorted({s for c, s in cells if c in demand})
    node = {("c", c): 1 + i for i, c in enumerate(cats)} | {("s", s): 1 + len(cats) + i for i, s in enumerate(stages)}
    source, sink = 0, 1 + len(cats) + len(stages)
    there = {c: sum(n for (x, _), n in cells.items() if x == c) for c in cats}
    want = sum(min(demand[c], there[c]) for c in cats)
    total = max(1, sum(there.values()))
    arcs = [(source, node["c", c], demand[c], 0) for c in cats]
    slack = {c: len(arcs) + i for i, c in enumerate(cats)}
    arcs += [(node["c", c], sink, demand[c], 1000) for c in cats]
    at: dict[tuple[str, str], list[int]] = {}
    for (c, s), n in sorted(cells.items()):
        if c in demand and n > 0:
            fair = min(n, math.ceil(demand[c] * n / there[c]))
            at[c, s] = [len(arcs), len(arcs) + 1]
            arcs += [(node["c", c], node["s", s], fair, 0), (node["c", c], node["s", s], n - fair, 1)]
    for s in stages:
        margin = math.ceil(want * sum(n for (c, x), n in cells.items() if x == s and c in demand) / total)
        arcs += [(node["s", s], sink, margin, 0), (node["s", s], sink, _BIG, 2)]
    flow = min_cost_flow(arcs, source, sink, sink + 1)
    return {k: sum(flow[e] for e in v) for k, v in at.items()}, {c: flow[e] for c, e in slack.items()}


def usable(records: DataFrame) -> DataFrame:
    """eval_id, category, stage of each distinct eval_id with a success and a known category (keys in one spelling).

    Of several rows of one eval_id the smallest (category, stage) counts.
    """
    ok = records.filter(F.col("eval_id").isNotNull() & is_success(F.col("status"))).select("eval_id", category_key(F.col("category")).alias("category"), F.coalesce(name_key(F.col("stage")), F.lit("")).alias("stage"))
    return ok.filter(F.col("category").isNotNull()).groupBy("eval_id").agg(F.min(F.struct("category", "stage")).alias("k")).select("eval_id", "k.*")


def plan(records: DataFrame, targets: DataFrame, share: float = SAMPLE_SHARE) -> tuple[DataFrame, list[dict], int]:
    """Quota table (category, stage, budget), report rows per target category, and the sample size."""
    spark = records.sparkSession
    size = math.floor(records.agg(F.countDistinct("eval_id").alias("n")).first().n * share + 1e-9)
    t = targets.select(F.col("category").alias("name"), category_key(F.col("category")).alias("category"), "target_share", "min_rows")
    want = {r.category: (r.name, float(r.target_share or 0), int(r.min_rows or 0)) for r in t.filter(F.col("category").isNotNull()).collect()}
    rows = usable(records).filter(F.col("category").isin(*want)).groupBy("category", "stage").agg(F.count("*").alias("n")).limit(MAX_CELLS + 1).collect() if want else []
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; stages must be a category-like column")
    cells = {(r.category, r.stage): r.n for r in rows}
    demand = {c: max(0, math.ceil(max(s * size, m) - 1e-9)) for c, (_, s, m) in want.items()}
    quota, short = quotas(cells, demand)
    got = {c: sum(n for (x, _), n in quota.items() if x == c) for c in want}
    all_ = max(1, sum(got.values()))
    report = [{"category": name, "target_share": s, "min_rows": m, "wanted": demand[c], "available": sum(n for (x, _), n in cells.items() if x == c), "drawn": got[c], "actual_share": got[c] / all_, "short": short[c]} for c, (name, s, m) in sorted(want.items())]
    table = spark.createDataFrame([(c, s, float(n)) for (c, s), n in quota.items() if n] or [], "category string, stage string, budget double")
    return table, report, size


def draw(records: DataFrame, targets: DataFrame, share: float = SAMPLE_SHARE, seed: int = 7) -> DataFrame:
    """eval_id, category, stage of the sample."""
    table, _, _ = plan(records, targets, share)
    u = spill(usable(records), "usable")  # read once per refinement and once more
    return take_by_hash(u, ["category", "stage"], F.lit(1.0), hash_rank(F.col("eval_id"), seed=seed), table).select("eval_id", "category", "stage")


REPORT = "category string, target_share double, min_rows int, wanted long, available long, drawn long, actual_share double, short long"


def shortfalls(records: DataFrame, targets: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """The report: per target category what was wanted, available, drawn and by how much it falls short (the flow on its slack arc)."""
    _, report, _ = plan(records, targets, share)
    return records.sparkSession.createDataFrame(report, REPORT)
