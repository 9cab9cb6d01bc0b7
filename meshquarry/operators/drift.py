"""Schemas that drift between files: one consistent table and a list of the changes.

Each file's fields (presence, type, sample values) are summarised by one grouped
aggregation over the parsed records. A file is compared with the writer's preceding
file; where fields go and others come at once, similarity flooding over the two
small schema graphs (words of names, types, nesting, values) finds which of them
correspond. No word is known to mean the same as another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.session import release, salted_join, spill

#: A file has a field if at least this share of its records hold it.
MIN_SHARE = 0.1
#: Correspondences below this share of the similarity of two equal fields are no renames.
MIN_SIMILARITY = 0.15
#: How much of a pair's similarity flows along each kind of edge.
FLOW = {"word": 1.0, "value": 1.0, "key": 1.0, "type": 0.3}
#: The flow ends when no similarity moves by more than this; it is a contraction and gets there in some ten rounds.
STILL = 1e-4


def name_tokens(name: str) -> list[str]:
    """Words of a field name: snake and camel case split, lower case, plural s dropped."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in re.split(r"[^A-Za-z0-9]+", words.lower()) if w]


def _expand(a: list[str], b: list[str]) -> list[str]:
    """Words of ``a`` where one that is the initials of words in a row of ``b`` is replaced by these."""
    out = []
    for w in a:
        hit = next((b[i : i + len(w)] for i in range(len(b)) if len(w) > 1 and "".join(x[0] for x in b[i : i + len(w)]) == w), None)
        out += hit or [w]
    return out


def word_similarity(x: str, y: str) -> float:
    """1 for the same word, more than a half for an abbreviation by its beginning, else the overlap of trigrams."""
    if x == y:
        return 1.0
    short, long = sorted((x, y), key=len)
    g = [{f" {w} "[i : i + 3] for i in range(len(w))} for w in (x, y)]
    begins = (1 + len(short) / len(long)) / 2 if len(short) >= 3 and long.startswith(short) else 0.0
    return max(begins, len(g[0] & g[1]) / len(g[0] | g[1]))


def _equal(x: str, y: str) -> float:
    return float(x == y)


def flood(gone: list[dict], come: list[dict], kept: list[dict]) -> np.ndarray:
    """Similarity flooding: how alike each gone field is to each coming one, as a share of what two equal fields reach.

    A field is a dict of name, type (None: only nulls), keys (nested names) and values (samples). Each schema is a graph
    of fields with edges to the words of their names, their types, nested names and values. The nodes of the pairwise
    connectivity graph are pairs of nodes, one of each schema; a pair of fields has an edge of each kind to every pair
    of its words, types, nested names or values. Pairs start with the likeness of their texts, pairs of fields with
    nothing, and in each round every pair passes its similarity on along its edges, until none changes. ``kept`` fields
    take part as pairs with themselves, so a word or type that many fields share says less; a pair of equal fields that
    share nothing with any other sets the scale.
    """
    nodes: dict[tuple, int] = {}
    start: list[float] = []
    edges: dict[tuple[str, int], list[tuple[int, float, float]]] = {}

    def node(kind: str, x: object, y: object, at: float) -> int:
        k = (kind, x, y)
        if k not in nodes:
            nodes[k] = len(start)
            start.append(at)
        return nodes[k]

    def link(field: int, kind: str, xs: list[str], ys: list[str], alike: Callable[[str, str], float], best: int) -> None:
        for x in xs:
            for y in ys:
                edges.setdefault((kind, node(kind, x, y, alike(x, y))), []).append((field, FLOW[kind] / best, 1 / (len(xs) * len(ys))))

    def pair(tag: tuple, f: dict, g: dict) -> int:
        n = node("field", *tag, 0.0)
        a, b = name_tokens(f["name"]) or [f["name"]], name_tokens(g["name"]) or [g["name"]]
        a, b = _expand(a, b), _expand(b, a)
        link(n, "word", a, b, word_similarity, max(len(a), len(b)))
        if f["type"] is not None and g["type"] is not None:
            link(n, "type", [f["type"]], [g["type"]], _equal, 1)
        for kind, alike, best in (("values", _equal, min), ("keys", word_similarity, max)):
            xs, ys = (sorted({v for v in (() if h[kind] is None else h[kind]) if v is not None}) for h in (f, g))
            if xs and ys:
                link(n, kind[:-1], xs, ys, alike, best(len(xs), len(ys)))
        return n

    own = {"name": "\0", "type": "\0", "keys": None, "values": ["\0"]}
    scale = pair(("equal", "equal"), own, own)
    for k, f in enumerate(kept):
        pair(("kept", k), f, f)
    at = np.array([[pair((i, j), f, g) for j, g in enumerate(come)] for i, f in enumerate(gone)])
    to, by, weight = [], [], []
    for (_, m), ends in edges.items():
        for n, up, down in ends:
            to += [n, m]
            by += [m, n]
            weight += [up / len(ends) ** 0.5, down / len(ends)]
    first = np.array(start)
    now, to, by, weight = first.copy(), np.array(to), np.array(by), np.array(weight)
    while True:
        said = first + now
        after = said + np.bincount(to, weight * said[by], len(first))
        after /= after.max()
        moved, now = np.abs(after - now).max(), after
        if moved < STILL:
            return now[at] / now[scale]


def correspondences(gone: list[dict], come: list[dict], kept: list[dict] = ()) -> list[tuple[str, str]]:
    """One-to-one (old name, new name) of the same type, the most similar first; ties by name."""
    if not len(gone) or not len(come):
        return []
    s = flood(gone, come, kept)
    ranked = sorted(((-s[i, j], f["name"], g["name"], f["type"], g["type"]) for i, f in enumerate(gone) for j, g in enumerate(come)))
    out: list[tuple[str, str]] = []
    for minus, old, new, a, b in ranked:
        same = a is None or b is None or a == b
        if -minus >= MIN_SIMILARITY and same and old not in {x for x, _ in out} and new not in {y for _, y in out}:
            out.append((old, new))
    return out


def _renames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(f, old, new) for f, g, c, k in zip(pdf.trace_file, pdf.gone, pdf.come, pdf.kept) for old, new in correspondences(list(g), list(c), list(k))]
        yield pd.DataFrame(rows, columns=["trace_file", "old_name", "new_name"])


def complete_records(lines: DataFrame, bare_as: str = "0") -> DataFrame:
    """The lines whose payload is one complete JSON object, with it as a variant ``v``.

    NaN and infinities, which JSON writers of the traces emit as bare words, are read
    as ``bare_as`` (``$2`` is the word itself).
    """
    bare = F.regexp_replace("payload", r"([:\[,]\s*)(NaN|[+-]?Infinity)(?=\s*[,}\]])", f"$1 {bare_as}")
    bare = F.when(F.contains("payload", F.lit("NaN")) | F.contains("payload", F.lit("Infinity")), bare).otherwise(F.col("payload"))
    text = F.trim("payload", F.lit(" \t\r\n"))
    v = F.try_parse_json(F.when(text.startswith("{") & text.endswith("}"), bare))
    return lines.withColumn("v", v).filter(F.col("v").isNotNull())


def writer_of(c: Column) -> Column:
    """WRITER of ``trace_WRITER_CODE.jsonl``; the whole name where it has another form."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^trace_(.+)_[^_]*\.jsonl$", 1), F.lit("")), c)


def file_fields(lines: DataFrame) -> DataFrame:
    """One row per file: trace_file, records, writer, seq, all names, and its fields (name, type or null for only nulls, n, keys, values).

    Keys are the names nested anywhere in a field's objects, values the hashes of up to four of its values: those that come
    first and last in two random orders, the same in every file, so equal sets of values have equal samples.

    Columns read: trace_file, written_at, payload. Rows without a file are dropped.
    """
    recs = complete_records(lines.filter(F.col("trace_file").isNotNull()).select("trace_file", "written_at", "payload"))
    spark = lines.sparkSession
    entries = spark.sql(
        """SELECT r.trace_file, r.written_at, e.pos, e.key AS name, e.value AS val, to_json(e.value) AS text
           FROM {recs} AS r, LATERAL variant_explode_outer(r.v) AS e""",
        recs=recs.select("trace_file", "written_at", "v"),
    )
    first = F.substring("text", 1, 1)
    kind = F.when(first == '"', "string").when(first == "[", "array").when(first == "{", "object").when(first.isin("t", "f"), "boolean").when(first != "n", "number")
    # only nested values are looked at for their shape; texts count by hash, so the sums run in Spark's hash aggregation
    shape = F.when(kind.isin("array", "object"), F.expr("schema_of_variant(val)"))
    a, b = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    marks = [F.when(kind.isNotNull(), h) for h in (a, b)]
    entries = entries.select("trace_file", "written_at", "pos", "name", kind.alias("type"), shape.alias("shape"), *(m.alias(f"h{i}") for i, m in enumerate(marks)))
    per_type = entries.groupBy("trace_file", "name", "type", "shape").agg(
        F.count("*").alias("n"), F.min("written_at").alias("first_at"), F.count(F.when(F.col("pos") == 0, 1)).alias("n_first"),
        *(f(f"h{i}").alias(f"{n}{i}") for i in range(2) for n, f in (("lo", F.min), ("hi", F.max))),
    )
    marks = [f"{n}{i}" for i in range(2) for n in ("lo", "hi")]
    per_type = per_type.groupBy("trace_file", "name", "type").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.sum("n_first").alias("n_first"), F.array_join(F.collect_set("shape"), ";").alias("inner"),
        F.struct(*((F.min if m[:2] == "lo" else F.max)(m).alias(m) for m in marks)).alias("marks"),
    )
    strength = F.struct(F.col("type").isNotNull().alias("typed"), F.col("n"), F.col("type"))
    per_field = per_type.groupBy("trace_file", "name").agg(
        F.max_by("type", strength).alias("type"), F.sum("n").alias("n"), F.sum("n_first").alias("n_first"), F.min("first_at").alias("first_at"),
        F.max_by("inner", strength).alias("inner"), F.max_by("marks", strength).alias("marks"),
    )
    keys = F.array_distinct(F.regexp_extract_all("inner", F.lit(r"[<,] *`?([^<>:,`]+)`?:"), F.lit(1)))
    values = F.array_distinct(F.array_compact(F.array(*(F.col(f"marks.{m}").cast("string") for m in marks))))
    files = per_field.groupBy("trace_file").agg(
        F.min("first_at").alias("first_at"), F.sum("n_first").alias("records"),
        F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "type", "n", keys.alias("keys"), values.alias("values")))).alias("fields"),
        F.array_compact(F.collect_list("name")).alias("names"),
    )
    files = files.withColumn("fields", F.filter("fields", lambda f: f["n"] >= MIN_SHARE * F.col("records"))).withColumn("writer", writer_of(F.col("trace_file")))
    return files.withColumn("seq", F.row_number().over(W.partitionBy("writer").orderBy("first_at", "trace_file"))).drop("first_at")


def _fields(files: DataFrame) -> DataFrame:
    """writer, seq, trace_file and one field f per row; f is null for a file without fields."""
    return files.select("trace_file", "writer", "seq", F.explode_outer("fields").alias("f"))


def _compare(files: DataFrame) -> DataFrame:
    """Each file with its fields now and those of its writer's preceding file; types of null-only fields carried on."""
    known = F.last("f.type", ignorenulls=True).over(W.partitionBy("writer", "f.name").orderBy("seq"))
    f = _fields(files).withColumn("f", F.when(F.col("f").isNotNull(), F.col("f").withField("type", known)))
    whole = f.groupBy("writer", "seq", "trace_file").agg(F.array_sort(F.collect_list("f")).alias("now"))
    w = W.partitionBy("writer").orderBy("seq")
    return whole.withColumn("before", F.lag("now").over(w)).filter(F.col("before").isNotNull())


def _retyped(files: DataFrame, renames: DataFrame) -> DataFrame:
    """trace_file, field_name of fields whose type differs from that in the preceding file.

    A field of nulls only keeps its type, also through a rename: then it starts with the old field's type.
    """
    f = _fields(files).filter(F.col("f").isNotNull()).select("trace_file", "writer", "seq", F.col("f.name").alias("field_name"), F.col("f.type").alias("type"))
    f = f.join(renames.select("trace_file", F.col("new_name").alias("field_name"), "old_type"), ["trace_file", "field_name"], "left")
    w = W.partitionBy("writer", "field_name").orderBy("seq")
    f = f.withColumn("known", F.last(F.coalesce("type", "old_type"), ignorenulls=True).over(w))
    f = f.withColumn("was", F.lag("known").over(w)).withColumn("was_seq", F.lag("seq").over(w))
    return f.filter((F.col("was_seq") == F.col("seq") - 1) & (F.col("was") != F.col("known"))).select("trace_file", "field_name")


def schema_changes(lines: DataFrame) -> DataFrame:
    """trace_file, field_name, change_kind and, for a rename, old_name: each change between a file and its writer's preceding file.

    A writer's first file has no changes; files without any complete record are
    passed over; repeated lines only weigh more. An empty table gives an empty result.
    """
    return changes_of(spill(file_fields(lines), "files"))


def changes_of(files: DataFrame) -> DataFrame:
    """:func:`schema_changes` from the table of :func:`file_fields`."""
    pairs = spill(_compare(files), "drift")
    without = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.transform(F.col(b), lambda y: y["name"]), x["name"]))
    pairs = pairs.select("trace_file", "before", without("before", "now").alias("gone"), without("now", "before").alias("come"), "now")
    kept = F.filter("now", lambda x: F.array_contains(F.transform("before", lambda y: y["name"]), x["name"]))
    both = pairs.filter((F.size("gone") > 0) & (F.size("come") > 0))
    found = both.select("trace_file", "gone", "come", kept.alias("kept")).mapInPandas(_renames, "trace_file string, old_name string, new_name string")
    then = both.select("trace_file", F.map_from_entries(F.transform("before", lambda x: F.struct(x["name"], x["type"]))).alias("then"))
    renames = spill(found.join(then, "trace_file").select("trace_file", "old_name", "new_name", F.element_at("then", F.col("old_name")).alias("old_type")), "renames")
    ren = renames.groupBy("trace_file").agg(F.collect_list("old_name").alias("olds"), F.collect_list("new_name").alias("news"))
    none = F.array().cast("array<string>")
    p = pairs.join(ren, "trace_file", "left").select("trace_file", "gone", "come", F.coalesce("olds", none).alias("olds"), F.coalesce("news", none).alias("news"))
    change = lambda x, kind: F.struct(x["name"].alias("field_name"), F.lit(kind).alias("change_kind"))
    moved = F.concat(
        F.transform(F.filter("come", lambda x: ~F.array_contains("news", x["name"])), lambda x: change(x, "added")),
        F.transform(F.filter("gone", lambda x: ~F.array_contains("olds", x["name"])), lambda x: change(x, "removed")),
    )
    no_name = F.lit(None).cast("string").alias("old_name")
    out = p.select("trace_file", F.explode(moved).alias("c")).select("trace_file", "c.*", no_name)
    out = out.union(renames.select("trace_file", "new_name", F.lit("renamed"), "old_name"))
    return out.union(_retyped(files, renames).select("trace_file", "field_name", F.lit("retyped"), no_name))


#: Columns of the consistent table and their types (fixed values).
TRACE_COLUMNS = {"schema_version": "bigint", "category": "string", "mesh": "string", "source": "string", "step": "bigint", "action": "bigint", "bbox_idx": "bigint", "coord_idx": "bigint", "scale_idx": "bigint", "num_bbox": "bigint", "reward": "double", "bvs": "double", "volume_sum": "double", "num_action_scale": "bigint", "manifold_volume_method": "string", "reward_backend": "string", "candidate_backend": "string", "max_step": "bigint", "trace_seed": "bigint", "pen_rate": "double", "branch_group": "string", "selected": "boolean"}


def canonical_names(changes: DataFrame) -> DataFrame:
    """name and canonical: names that renames tie, each set under one of its names.

    A name of :data:`TRACE_COLUMNS` goes before any other, then the name most often renamed from, then the last. Labels
    spread to neighbours and along pointers until none changes, however long a chain of renames is.
    """
    r = changes.filter(F.col("change_kind") == "renamed").groupBy("old_name", F.col("field_name").alias("new_name")).count()
    both = r.select(F.col("old_name").alias("a"), F.col("new_name").alias("b"), "count").union(r.select("new_name", "old_name", F.lit(0).cast("long")))
    links = spill(both.groupBy("a", "b").agg(F.sum("count").alias("count")), "links")
    own = F.struct(F.col("a").isin(*TRACE_COLUMNS).alias("column"), F.sum("count").alias("n"), F.col("a").alias("best"))
    label = spill(links.groupBy("a").agg(own.alias("label")).select(F.col("a").alias("name"), "label"), "label")
    while True:
        near = links.join(label, links.b == label.name).select(F.col("a").alias("name"), "label")
        jump = label.select(F.col("name").alias("best"), F.col("label").alias("far"))
        far = label.select("name", F.col("label.best").alias("best")).join(jump, "best").select("name", F.col("far").alias("label"))
        best = near.union(far).groupBy("name").agg(F.max("label").alias("next"))
        after = spill(label.join(best, "name").select("name", F.greatest("label", "next").alias("label"), (F.col("next") > F.col("label")).alias("moved")), "label")
        moved = not after.filter("moved").isEmpty()
        release(label)
        label = after
        if not moved:
            return label.select("name", F.col("label.best").alias("canonical"))


def consistent_table(lines: DataFrame) -> DataFrame:
    """All complete records as one table of :data:`TRACE_COLUMNS`, fields read under any of their names and cast.

    A value in an array or object of one element is that element. What can't be cast is null. Fields outside the
    columns are kept as JSON text in ``rest``. The other names of a file's fields travel with the file, so neither the
    driver nor any task holds all names.
    """
    files = spill(file_fields(lines), "files")
    names = canonical_names(changes_of(files))
    said = files.select("trace_file", F.explode("names").alias("name")).join(names.filter(F.col("name") != F.col("canonical")), "name")
    alias = spill(said.groupBy("trace_file").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("alias")), "alias")
    recs = complete_records(lines.select("line_id", "trace_file", "line_no", "payload"), '"$2"')
    r = salted_join(recs, alias, "trace_file", F.col("line_id")).withColumn("m", F.expr("cast(v as map<string,variant>)"))
    r = r.withColumn("m", F.map_from_entries(F.array_distinct(F.transform(F.map_entries("m"), lambda e: F.struct(F.coalesce(F.element_at("alias", e["key"]), e["key"]).alias("key"), F.to_json(e["value"]).alias("value"))))))
    one = lambda x: F.regexp_replace(F.regexp_replace(x, r'^(?:\[([^,\[\]{}]*)\]|\{"[^"]*":([^,\[\]{}]*)\})$', "$1$2"), '^"(.*)"$', "$1")
    cast = lambda c, t: F.expr(f"try_cast(try_cast({c} as double) as bigint)") if t == "bigint" else F.expr(f"try_cast({c} as {t})")
    r = r.select("line_id", "trace_file", "line_no", "m", *(one(F.element_at("m", c)).alias(f"_{c}") for c in TRACE_COLUMNS))
    rest = F.to_json(F.map_filter("m", lambda k, _: ~k.isin(*TRACE_COLUMNS)))
    return r.select("line_id", "trace_file", "line_no", *(cast(f"_{c}", t).alias(c) for c, t in TRACE_COLUMNS.items()), F.nullif(rest, F.lit("{}")).alias("rest"))
