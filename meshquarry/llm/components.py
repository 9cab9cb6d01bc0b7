"""Splits that keep related records together: frontier breadth-first components.

Adjacency is a table hash-partitioned by vertex. Many seeds (vertices whose hash is the
least in their neighbourhood) expand their frontiers at once; each vertex takes the label
that reaches it first. Where labels collide, an edge of a smaller graph joins them; that
graph is solved in the same way until no edge is left. Everything stays in tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions.text import author_key, name_key, squeeze
from meshquarry.session import maybe_broadcast, release, salted_join, spill, spill_bucketed

#: A group of more than this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 1 / 1000
#: A hot hub is split into this many sub-hubs.
SUB_HUBS = 64
MAX_LEVELS = 60


def components(edges: DataFrame) -> DataFrame:
    """v, component of each vertex of ``edges`` (a, b: longs, in any order, repeated or not); component is one of its vertices.

    Edges with a null end and loops are left out.
    """
    e = spill(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b"), "edges")
    levels = []
    for _ in range(MAX_LEVELS):
        n = 2 * e.count()
        if not n:
            break
        adj = spill_bucketed(e.union(e.select("b", "a")).distinct(), "a", n, "adj")
        label = _label(adj)
        levels.append(label)
        la, lb = label.select(F.col("v").alias("a"), F.col("l").alias("la")), label.select(F.col("v").alias("b"), F.col("l").alias("lb"))
        up = spill(adj.filter(F.col("a") < F.col("b")).join(la, "a").join(lb, "b").filter(F.col("la") != F.col("lb")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        release(e, adj)
        e = up
    else:
        raise RuntimeError("components did not converge")
    if not levels:
        return edges.select(F.col("a").cast("long").alias("v"), F.col("a").cast("long").alias("component")).limit(0)
    top = levels[-1]
    for lower in reversed(levels[:-1]):
        up = top.select(F.col("v").alias("l"), F.col("l").alias("up"))
        top = salted_join(lower, up, "l", F.col("v")).select("v", F.coalesce("up", "l").alias("l"))
        top = spill(top, "label")
    return top.select("v", F.col("l").alias("component"))


def _label(adj: DataFrame) -> DataFrame:
    """v, l: each vertex with the seed whose frontier reaches it first (the least of those that do at once).

    A vertex whose hash is below those of all its neighbours is a seed; since every vertex has a neighbour, at most half
    of the vertices are, and every other vertex is reached from a seed in a few rounds. ``adj`` is partitioned by its
    vertex a, so a round shuffles the frontier and what it reaches, never the adjacency.
    """
    h = lambda c: F.struct(F.xxhash64(c), F.col(c))
    least = adj.groupBy(F.col("a").alias("v")).agg(F.min(h("b")).alias("m"))
    seeds = least.filter(h("v") < F.col("m")).select("v", F.col("v").alias("l"))
    visited = frontier = spill(seeds, "seen")
    while True:
        reach = adj.join(frontier.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("l").alias("l"))
        frontier = spill(reach.join(visited, "v", "left_anti"), "front")
        if frontier.isEmpty():
            return visited
        visited = visited.union(frontier)  # written tables; nothing is computed again


def hub_edges(rows: DataFrame, member: str, group: str) -> DataFrame:
    """a, b: edges that tie the members (longs) of each group (string key) through a hub vertex (a negative long).

    The hub of a hot group is split: members hang on sub-hubs by their hash, sub-hubs on the hub, so no vertex takes a
    third of all edges in one task.
    """
    r = rows.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(member).alias("m"), F.col(group).alias("g"))
    hub = lambda *c: -F.pmod(F.xxhash64(*c), F.lit((1 << 62) - 1)) - 1
    sizes = r.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    n = rows.count()
    hot = sizes.filter(F.col("n") > max(1000, n * HOT)).select("g", F.lit(True).alias("hot"))  # at most 1 / HOT rows
    r = r.join(F.broadcast(hot), "g", "left")
    sub = F.when(F.col("hot"), F.pmod(F.xxhash64("m"), F.lit(SUB_HUBS)))
    top, low = hub(F.lit("hub"), F.col("g")), hub(F.lit("sub"), F.col("g"), sub)
    cold = r.filter(F.col("hot").isNull()).select(F.col("m").alias("a"), top.alias("b"))
    warm = r.filter(F.col("hot").isNotNull())
    return cold.union(warm.select(F.col("m").alias("a"), low.alias("b"))).union(warm.select(low.alias("a"), top.alias("b")).distinct())


def _names(c: Column) -> Column:
    """Mesh keys named in one gate row: one name or several in a list of any form, JSON (with its escapes) included."""
    plain = F.split(F.regexp_replace(c, r'[\[\]"]', ""), r"\s*(?:[|,;&]|\s\+\s|\s+and\s+)\s*")
    parts = F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), plain)
    return F.array_distinct(F.filter(F.transform(parts, name_key), lambda x: x != ""))


def _path_names(path: Column) -> Column:
    """Keys of the folder that holds the file of a path."""
    p = F.split(F.lower(F.trim(path)), r"[/\\]+")
    return F.when(F.size(p) >= 2, squeeze(F.element_at(p, -2)))


def mesh_edges(meshes: DataFrame, gate_rows: DataFrame, evaluations: DataFrame) -> DataFrame:
    """a, b (mesh_no): ties between meshes of ``meshes``.

    Ties: the same author; derived_from; a mesh_id that is another's followed by ``_`` or ``-`` and more; a gate row that
    names both; an evaluation record that names both in mesh_id and its paths. Names outside the table tie nothing.
    """
    m = spill(meshes.filter(F.col("mesh_no").isNotNull()).select(F.col("mesh_no").cast("long"), F.lower(F.trim("mesh_id")).alias("mesh_id"), name_key(F.col("mesh_id")).alias("key"), author_key(F.col("author")).alias("author"), name_key(F.col("derived_from")).alias("parent")), "mesh")
    known = m.filter(F.col("key") != "").select("key", "mesh_no")
    same = hub_edges(m, "mesh_no", "author")
    parent = m.filter(F.col("parent") != "").select(F.col("mesh_no").alias("a"), F.col("parent").alias("key")).join(maybe_broadcast(known), "key").select("a", F.col("mesh_no").alias("b"))
    # every proper prefix that ends before a _ or -
    cuts = F.expr("transform(filter(sequence(2, greatest(length(mesh_id) - 1, 2)), i -> substr(mesh_id, i, 1) IN ('_', '-')), i -> substr(mesh_id, 1, i - 1))")
    prefix = m.filter(F.length("mesh_id") > 2).select(F.col("mesh_no").alias("a"), F.explode(cuts).alias("mesh_id")).join(m.select("mesh_id", F.col("mesh_no").alias("b")), "mesh_id").select("a", "b")
    several = gate_rows.select(_names(F.col("mesh_id")).alias("names"))
    own = name_key(F.col("mesh_id"))
    paths = evaluations.select(F.array_distinct(F.filter(F.array(own, *(_path_names(F.col(c)) for c in ("mesh_path", "surface_path", "bbox_path"))), lambda x: x.isNotNull() & (x != ""))).alias("names"))
    # few rows name more than one mesh; the others never leave the scan
    rows = several.union(paths).filter(F.size("names") > 1).distinct().select(F.explode("names").alias("key"), F.xxhash64("names").alias("row"), F.to_json("names").alias("id"))
    named = spill(rows.join(maybe_broadcast(known), "key").select("mesh_no", "id"), "named")  # few rows; read three times
    return parent.union(prefix).union(hub_edges(named, "mesh_no", "id")).union(same)


def mesh_components(meshes: DataFrame, gate_rows: DataFrame, evaluations: DataFrame) -> DataFrame:
    """mesh_no, component (the least mesh_no of those tied) of every mesh; one that is tied to none is its own component."""
    c = spill(components(mesh_edges(meshes, gate_rows, evaluations)).filter(F.col("v") >= 0), "comp")
    least = c.groupBy("component").agg(F.min("v").alias("least"))
    c = salted_join(c, least, "component", F.col("v"), how="inner").select(F.col("v").alias("mesh_no"), F.col("least").alias("component"))
    return meshes.filter(F.col("mesh_no").isNotNull()).select("mesh_no").join(c, "mesh_no", "left").withColumn("component", F.coalesce("component", "mesh_no"))


#: Members of a component that meet the others in one task when pairs are wanted.
SLOT = 256


def tied_pairs(member: DataFrame) -> DataFrame:
    """mesh_no_a < mesh_no_b of one component, from (mesh_no, component).

    The result has every pair, so it grows with the square of a component; (mesh_no, component) says the same in one row per
    mesh. A large component is cut into slots by hash: each member meets one slot of the others per task.
    """
    c = spill(member, "member")
    big = c.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("component", F.ceil(F.col("n") / SLOT).alias("slots"))
    c = spill(salted_join(c, big, "component", F.col("mesh_no"), how="inner"), "tied")
    left = c.select("component", F.col("mesh_no").alias("mesh_no_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    right = c.select("component", F.col("mesh_no").alias("mesh_no_b"), F.pmod(F.xxhash64("mesh_no"), F.col("slots")).alias("slot"))
    return left.join(right, ["component", "slot"]).filter(F.col("mesh_no_a") < F.col("mesh_no_b")).select("mesh_no_a", "mesh_no_b")


def assign_splits(weights: DataFrame, targets: list[tuple[str, float]], seed: int = 3, buckets: int = 4096) -> DataFrame:
    """component, n, split: components in hash order fill the splits one after the other.

    ``weights`` has component and n (its records). A component goes to the split in whose range the middle of its
    records falls; running sums go over at most ``buckets`` bucket sums, then within each bucket.
    """
    rank = F.pmod(F.xxhash64(F.lit(seed), F.col("component")), F.lit(1 << 62))
    d = weights.withColumn("r", rank).withColumn("bkt", F.floor(F.col("r") / F.lit((1 << 62) // buckets)).cast("int"))
    sums = d.groupBy("bkt").agg(F.sum("n").alias("s"))
    one = W.partitionBy(F.lit(0))  # at most `buckets` rows
    starts = sums.select("bkt", (F.sum("s").over(one.orderBy("bkt")) - F.col("s")).alias("start"), F.sum("s").over(one).alias("all"))
    inner = W.partitionBy("bkt").orderBy("r", "component")
    d = d.join(F.broadcast(starts), "bkt").withColumn("mid", (F.col("start") + F.sum("n").over(inner) - F.col("n") / 2) / F.col("all"))
    total, upto, split = sum(t for _, t in targets) or 1.0, 0.0, F.lit(targets[-1][0])
    for name, edge in reversed([(n, sum(t for _, t in targets[: i + 1]) / total) for i, (n, _) in enumerate(targets[:-1])]):
        split = F.when(F.col("mid") < edge, F.lit(name)).otherwise(split)
    return d.select("component", "n", split.alias("split"))


def record_splits(meshes: DataFrame, gate_rows: DataFrame, evaluations: DataFrame, targets: DataFrame) -> DataFrame:
    """kind ('evaluation' or 'gate'), record_id, group, split of every record.

    The group of a record is the component of its mesh; records of a mesh outside the table group by its key, records
    without a mesh by themselves. Split shares follow the records.
    """
    m = spill(mesh_components(meshes, gate_rows, evaluations), "member")
    keys = meshes.select("mesh_no", name_key(F.col("mesh_id")).alias("key")).join(m, "mesh_no").groupBy("key").agg(F.min("component").alias("component"))
    ev = evaluations.select(F.lit("evaluation").alias("kind"), F.col("eval_id").cast("long").alias("record_id"), name_key(F.col("mesh_id")).alias("key")).distinct()
    # the first name outside or inside the table stands for a gate row: all inside are of one component
    ga = gate_rows.select(F.lit("gate").alias("kind"), F.col("gate_id").cast("long").alias("record_id"), F.explode_outer(_names(F.col("mesh_id"))).alias("key"))
    recs = salted_join(ev.union(ga), keys, "key", F.col("record_id"))
    own = F.coalesce(F.concat(F.lit("c"), F.col("component").cast("string")), F.concat(F.lit("k"), F.nullif(F.col("key"), F.lit(""))), F.concat("kind", F.col("record_id").cast("string")))
    recs = spill(recs.groupBy("kind", "record_id").agg(F.min(own).alias("group")), "recs")
    t = [(r.split_name, float(r.target_share)) for r in targets.filter(F.col("split_name").isNotNull() & (F.col("target_share") > 0)).orderBy(F.desc("target_share"), "split_name").collect()]
    s = assign_splits(recs.groupBy(F.col("group").alias("component")).agg(F.count("*").alias("n")), t)
    return salted_join(recs, s.select(F.col("component").alias("group"), "split"), "group", F.col("record_id"), how="inner").select("kind", "record_id", "group", "split")
