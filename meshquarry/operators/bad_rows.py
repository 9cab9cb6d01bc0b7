"""Rows that fail to parse: OBJ text lines loaded in bulk, faulty ones set apart with the reason.

Blocks of lines go through one bulk parse (one match over the text of the block, then one
column of numbers for all its vertices and one for its faces). A block that fails is bisected until single bad records remain, and only
those are diagnosed by the strict line rules. The per-file range rule then joins
each face with the number of vertex lines of its file (salted: one file may hold a
third of all lines).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.session import salted_join

#: Tags of the OBJ text format that are accepted (fixed values).
TAGS = ("v", "vt", "vn", "f", "o", "g", "s", "usemtl", "mtllib", "l", "p")
#: Reasons in the order in which they are tested (fixed values).
REASONS = ("tag", "quote", "columns", "value", "range")
#: Lines parsed at once, and lines in a failing block that are no longer bisected but diagnosed each; only speed depends on them.
BLOCK, LEAF = 128, 4

_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_TOKEN = re.compile(r"([+-]?\d+)(?:/[+-]?\d+|//[+-]?\d+|/[+-]?\d+/[+-]?\d+)?")
_N = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
_V = rf'[ \t]++(?:{_N}|"{_N}")'
_F = r"[ \t]++-?+[0-9]{1,9}(?:/-?+[0-9]++(?:/-?+[0-9]++)?+|//-?+[0-9]++)?+"
_REST = "|".join(t for t in TAGS if t not in "vf")
#: A block whose every line has a common form: vertices, faces, other tags with paired quotes, comments, blanks.
_BLOCK = re.compile(rf'(?:[ \t]*+(?:v(?:{_V}){{3}}(?:(?:{_V}){{3}}|{_V})?|f(?:{_F}){{3,}}+|(?:{_REST})(?:[ \t](?:[^\n"]++|"[^\n"]*+")*+)?+|\#[^\n]*+|)[ \t\r]*+\n)*+')

PARSED = "line_id long, obj_file string, line_no long, tag string, vertex array<double>, face_tokens array<string>, worst long, zero boolean, reason string"


def diagnose(raw: str | None) -> tuple[str | None, list[float] | None, list[str] | None, int | None, bool | None, str | None]:
    """One line by the strict rules: tag, vertex values, face tokens, largest absolute vertex index, whether an index is 0, reason.

    A null line counts as blank. Carriage returns at the ends belong to the line ends.
    """
    line = (raw or "").strip(" \t\r\n")
    if not line or line[0] == "#":
        return None, None, None, None, None, None
    words = re.split(r"[ \t]+", line)
    tag, args = words[0], words[1:]
    if tag not in TAGS:
        return tag, None, None, None, None, "tag"
    if line.count('"') % 2:
        return tag, None, None, None, None, "quote"
    if tag == "v":
        if len(args) not in (3, 4, 6):
            return tag, None, None, None, None, "columns"
        bare = [a[1:-1] if len(a) > 2 and a[0] == a[-1] == '"' else a for a in args]
        values = [float(a) if _NUMBER.fullmatch(a) and a.isascii() else math.nan for a in bare]
        return (tag, values, None, None, None, None) if all(map(math.isfinite, values)) else (tag, None, None, None, None, "value")
    if tag == "f":
        if len(args) < 3:
            return tag, None, None, None, None, "columns"
        found = [_TOKEN.fullmatch(a) if a.isascii() else None for a in args]
        if not all(found):
            return tag, None, None, None, None, "value"
        index = [int(m[1]) for m in found]
        return tag, None, args, min(max(map(abs, index)), 2**62), 0 in index, None
    return tag, None, None, None, None, None


def _bulk(lines: list[str]) -> list[tuple] | None:
    """The whole block at once: one match over its text, then its numbers as one column each; None if a line conforms to no common form."""
    text = "\n".join(lines) + "\n"
    if text.count("\n") != len(lines) or not _BLOCK.fullmatch(text):
        return None
    words = [t.split() for t in lines]
    out: list[tuple] = [(w[0] if w and w[0][0] != "#" else None, None, None, None, None, None) for w in words]
    vs, fs = [i for i, o in enumerate(out) if o[0] == "v"], [i for i, o in enumerate(out) if o[0] == "f"]
    if vs:
        column = [x.strip('"') for i in vs for x in words[i][1:]]
        values = np.array(column, dtype=np.float64)
        if not np.isfinite(values).all():
            return None
        flat, at = values.tolist(), 0
        for i in vs:
            n = len(words[i]) - 1
            out[i] = ("v", flat[at : at + n], None, None, None, None)
            at += n
    if fs:
        index, at = np.array([x.partition("/")[0] for i in fs for x in words[i][1:]], dtype=np.int64), 0
        for i in fs:
            toks = words[i][1:]
            own = index[at : at + len(toks)]
            out[i] = ("f", None, toks, int(np.abs(own).max()), bool((own == 0).any()), None)
            at += len(toks)
    return out


def parse_block(lines: list[str]) -> list[tuple]:
    """Parse a block; bisect where it fails, down to single records for :func:`diagnose`."""
    done = _bulk(lines)
    if done is not None:
        return done
    if len(lines) <= LEAF:
        return [diagnose(t) for t in lines]
    half = len(lines) // 2
    return parse_block(lines[:half]) + parse_block(lines[half:])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("line_id", pa.int64()), ("obj_file", pa.string()), ("line_no", pa.int64()), ("tag", pa.string()), ("vertex", pa.list_(pa.float64())), ("face_tokens", pa.list_(pa.string())), ("worst", pa.int64()), ("zero", pa.bool_()), ("reason", pa.string())])
    for b in batches:
        raw = pc.fill_null(b.column("raw_line"), "").to_pylist()
        rows = [r for i in range(0, len(raw), BLOCK) for r in parse_block(raw[i : i + BLOCK])]
        cols = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([b.column("line_id"), b.column("obj_file"), b.column("line_no"), *(pa.array(c, type=schema.field(k + 3).type) for k, c in enumerate(cols))], schema=schema)


def parse_obj_lines(lines: DataFrame) -> DataFrame:
    """Every line of ``lines`` (line_id, obj_file, line_no, raw_line; other columns are ignored) parsed, with the reason where it is faulty.

    Null raw lines count as blank; a null obj_file is a file of its own. Repeated rows are judged each.
    An empty table gives an empty result.
    """
    src = lines.select(F.col("line_id").cast("long"), F.coalesce("obj_file", F.lit("\0")).alias("obj_file"), F.col("line_no").cast("long"), "raw_line")
    parsed = src.mapInArrow(_parse, PARSED)
    counts = src.groupBy("obj_file").agg(F.sum(F.col("raw_line").rlike(r"^[ \t]*v(?:[ \t]|\r?\n?$)").cast("long")).alias("n_v"))
    joined = salted_join(parsed, counts, "obj_file", F.col("line_id"))
    out_of_range = F.col("worst").isNotNull() & (F.col("zero") | (F.col("worst") > F.coalesce("n_v", F.lit(0))))
    return joined.withColumn("reason", F.coalesce("reason", F.when(out_of_range, F.lit("range")))).drop("n_v", "worst", "zero")


def faulty_lines(lines: DataFrame) -> DataFrame:
    """line_id and reason of each faulty line."""
    return parse_obj_lines(lines).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def valid_vertices(lines: DataFrame) -> DataFrame:
    """The vertices that load: obj_file, line_no, x, y, z and the number of values."""
    p = parse_obj_lines(lines).filter(F.col("reason").isNull() & F.col("vertex").isNotNull())
    return p.select("line_id", "obj_file", "line_no", *(F.col("vertex")[i].alias(c) for i, c in enumerate("xyz")), F.size("vertex").alias("n_values"))


def valid_faces(lines: DataFrame) -> DataFrame:
    """The faces that load: obj_file, line_no, tokens and their number."""
    p = parse_obj_lines(lines).filter(F.col("reason").isNull() & F.col("face_tokens").isNotNull())
    return p.select("line_id", "obj_file", "line_no", "face_tokens", F.size("face_tokens").alias("n_tokens"))
