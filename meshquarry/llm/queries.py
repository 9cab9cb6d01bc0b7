"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.llm import components, cutoffs, leaks, mixture, percentiles, quota_sample, stuffing, survivors
from meshquarry.functions.text import source_key
from meshquarry.session import spill, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.superseded(table(spark, sf_dir, "stage_record"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.stage_survivors(table(spark, sf_dir, "stage_record"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, n) for n in ("mesh_model", "gate_row", "evaluation_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.tied_pairs(components.mesh_components(*_tables(spark, sf_dir)))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mesh with the least mesh_no of those it is tied to: what p2_found says in pairs."""
    return components.mesh_components(*_tables(spark, sf_dir))


def p2_record_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.record_splits(*_tables(spark, sf_dir), table(spark, sf_dir, "split_target"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.kept_states(table(spark, sf_dir, "gate_score"), table(spark, sf_dir, "gate_target")).select("state_id")


def p3_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.cutoffs(cutoffs.counted_states(table(spark, sf_dir, "gate_score")), table(spark, sf_dir, "gate_target"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.pack(percentiles.evaluation_histogram(table(spark, sf_dir, "evaluation_record")), ["category", "stage", "day"])


def p4_daily_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable partial results: one histogram per category, stage, metric and day, written as ``bucket:count``."""
    each = F.transform(F.arrays_zip("buckets", "counts"), lambda x: F.concat_ws(":", x["buckets"].cast("string"), x["counts"].cast("string")))
    return _days(spark, sf_dir).select("category", "stage", "day", "metric", F.size("buckets").alias("buckets"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.array_join(each, " ").alias("histogram"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["category", "stage"]
    return _rounded(percentiles.percentiles(percentiles.merge(percentiles.evaluation_histogram(table(spark, sf_dir, "evaluation_record")), by), by))


def p4_merged_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles, combined from the written histograms of single days."""
    days = spill(_days(spark, sf_dir), "days")
    by = ["category", "stage"]
    return _rounded(percentiles.percentiles(percentiles.merge(percentiles.unpack(days, [*by, "day"]), by), by))


def p4_signed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of signed values: how gate rows change bvs and viou, by category."""
    p = percentiles.percentiles(percentiles.delta_histogram(table(spark, sf_dir, "gate_row")), ["category"], (0.05, 0.25, 0.5, 0.75, 0.95))
    return p.select(*(F.round(c, 9).alias(c) if c[0] == "p" else c for c in p.columns))


def _rounded(p: DataFrame) -> DataFrame:
    return p.select(*(F.round(c, 6).alias(c) if c[0] == "p" and c[1:].isdigit() else c for c in p.columns))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quota_sample.shortfalls(table(spark, sf_dir, "evaluation_record"), table(spark, sf_dir, "sample_target"))
    return r.filter(F.col("short") > 0).select("category")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.shortfalls(table(spark, sf_dir, "evaluation_record"), table(spark, sf_dir, "sample_target"))


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.draw(table(spark, sf_dir, "evaluation_record"), table(spark, sf_dir, "sample_target"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, of how many sources, each item leaked into."""
    hit = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"))
    return hit.join(docs, "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc_id"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(*mixture.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stuffing.scored(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "source", F.round("page_score", 6).alias("page_score"), F.round("host_rate", 6).alias("host_rate"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_members, p2_record_splits, p3_found, p3_cutoffs, p4_daily_histograms, p4_percentiles, p4_merged_from_days, p4_signed_changes, p7_found, p7_report, p7_sample, p8_found, p8_items, p9_mixture, p9_shares, p10_found, p10_scores)}


def _key(c: str) -> str:
    """SQL of functions.text.name_key."""
    return rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({c}), e' \t\r\n'), '^.*[/\\]', ''), '\.(obj|off|ply|stl|msh|json|jsonl|csv|tsv|txt|parquet|log)$', ''), '[^\pL\pN]+', '', 'g')"


_OK = "regexp_replace(lower({}), '[^\\pL\\pN]+', '', 'g') IN ('success','succeeded','successful','succeed','ok','okay','done','passed','pass','complete','completed','finished')"
_CAT = f"nullif(nullif(regexp_replace({_key('category')}, '^shapenet', ''), ''), 'unknown')"
_TIED = f"""
WITH RECURSIVE m AS (SELECT mesh_no, lower(trim(mesh_id)) AS mesh_id, {_key("mesh_id")} AS k, {_key("derived_from")} AS parent,
  CASE WHEN regexp_replace(lower(author), '[^\\pL\\pN]+', '', 'g') NOT IN ('', 'na', 'none', 'unknown', 'anonymous', 'null', 'nobody', 'anon') THEN regexp_replace(lower(author), '[^\\pL\\pN]+', '', 'g') END AS au FROM mesh_model),
gn AS (SELECT gate_id, {_key("unnest(CASE WHEN trim(mesh_id)[1] = '[' THEN json_extract_string(mesh_id, '$[*]') ELSE string_split_regex(mesh_id, '[|,;]| [+] ') END)")} AS k FROM gate_row),
en AS (SELECT eval_id, {_key("mesh_id")} AS k, {_key("mesh_path[:-length(string_split(mesh_path, '/')[-1]) - 2]")} AS k1, {_key("surface_path[:-length(string_split(surface_path, '/')[-1]) - 2]")} AS k2, {_key("bbox_path[:-length(string_split(bbox_path, '/')[-1]) - 2]")} AS k3 FROM evaluation_record),
e AS (SELECT a.mesh_no AS x, b.mesh_no AS y FROM m a JOIN m b ON a.au = b.au
  UNION SELECT a.mesh_no, b.mesh_no FROM m a JOIN m b ON a.parent = b.k
  UNION SELECT a.mesh_no, b.mesh_no FROM m a JOIN m b ON a.mesh_id[:length(b.mesh_id)] = b.mesh_id AND a.mesh_id[length(b.mesh_id) + 1] IN ('_', '-') AND length(a.mesh_id) > length(b.mesh_id) + 1
  UNION SELECT a.mesh_no, b.mesh_no FROM gn g JOIN gn h USING (gate_id) JOIN m a ON g.k = a.k JOIN m b ON h.k = b.k
  UNION SELECT a.mesh_no, b.mesh_no FROM en JOIN m a ON en.k = a.k JOIN m b ON b.k IN (en.k1, en.k2, en.k3)),
s AS (SELECT DISTINCT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r AS (SELECT x, y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x)
"""

_G = math.log((1 + percentiles.ALPHA) / (1 - percentiles.ALPHA))
_OFF = math.ceil(745.2 / _G) + 1
_BUCKET = f"CAST(CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / {_G!r}::DOUBLE) + {_OFF}) END AS BIGINT)"
_HIST = f"""WITH r AS (SELECT eval_id, coalesce({_CAT}, 'unknown') AS category, coalesce(nullif({_key("stage")}, ''), 'unknown') AS stage, CAST(evaluated_at AS DATE) AS day, bvs, elapsed_sec FROM evaluation_record QUALIFY eval_id IS NULL OR row_number() OVER (PARTITION BY eval_id, CAST(evaluated_at AS DATE) ORDER BY ingested_at DESC NULLS LAST) = 1),
l AS (SELECT category, stage, day, 'bvs' AS metric, bvs AS x FROM r WHERE bvs >= 0 UNION ALL SELECT category, stage, day, 'elapsed_sec', elapsed_sec FROM r),
h AS (SELECT category, stage, day, metric, {_BUCKET} AS bucket, count(*) AS n FROM l WHERE isfinite(x) GROUP BY ALL)"""
_VALUE = f"round(sign({{0}}) * CASE WHEN {{0}} = 0 THEN 0 ELSE exp((abs({{0}}) - {_OFF}) * {_G!r}::DOUBLE) * {2 / (1 + (1 + percentiles.ALPHA) / (1 - percentiles.ALPHA))!r}::DOUBLE END, {{2}}) AS p{{1}}"


def _pct(hist: str, by: str, ps: tuple[float, ...], digits: int) -> str:
    marks = ", ".join(f"min(bucket) FILTER (WHERE upto >= greatest(1, ceil({p}::DOUBLE * total))) AS b{round(p * 100)}" for p in ps)
    values = ", ".join(_VALUE.format(f"b{round(p * 100)}", round(p * 100), digits) for p in ps)
    return f"""{hist}, m AS (SELECT {by}, metric, bucket, sum(n) AS n FROM h GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}, metric) AS total FROM m),
q AS (SELECT {by}, metric, max(total) AS n, {marks} FROM c GROUP BY {by}, metric) SELECT {by}, metric, n, {values}, {percentiles.ALPHA}::DOUBLE AS rel_error FROM q"""


_PCT = _pct(_HIST, "category, stage", percentiles.PERCENTILES, 6)
_SIGNED = f"""WITH l AS (SELECT coalesce({_CAT}, 'unknown') AS category, unnest(['delta_avg_bvs', 'delta_avg_viou']) AS metric, unnest([delta_avg_bvs, delta_avg_viou]) AS x FROM gate_row),
h AS (SELECT category, metric, {_BUCKET} AS bucket, count(*) AS n FROM l WHERE isfinite(x) GROUP BY ALL)"""
_AT = "CASE WHEN {0} > 0 AND NOT isnan({0}) THEN CASE WHEN {0} < 1e11 THEN {0} WHEN {0} < 1e14 THEN {0} / 1e3 WHEN {0} < 1e17 THEN {0} / 1e6 ELSE {0} / 1e9 END END"
_VOTED = {"category": _key("category"), "output_path": "output_path", "log_path": "log_path", "metadata": "metadata", "stage": "stage", "mesh_id": "mesh_id", "started_at": _AT.format("started_at"), "error": "CASE WHEN ok THEN coalesce(error, '') ELSE error END", "command": "command"}
_SURVIVORS = (
    f"""WITH r AS (SELECT *, coalesce({_key("stage")}, '') AS stage_key, coalesce({_key("mesh_id")}, '') AS mesh_key, coalesce({_OK.format("status")}, false) AS ok, {_AT.format("finished_at")} AS t FROM stage_record),
w AS (SELECT *, pow(2.0::DOUBLE, CASE WHEN t IS NULL THEN -100.0::DOUBLE ELSE greatest(-99.0::DOUBLE, least(100.0::DOUBLE, (t - 1.6e9) / (86400.0::DOUBLE * 180))) END) AS d FROM r),
run AS (SELECT stage_key, mesh_key, record_id AS survivor, CASE WHEN ok THEN 'success' ELSE lower(trim(status)) END AS status, t AS finished_at FROM w QUALIFY row_number() OVER (PARTITION BY stage_key, mesh_key ORDER BY ok DESC, t DESC NULLS LAST, record_id DESC) = 1)"""
    + "".join(
        f""",
v_{c} AS (SELECT stage_key, mesh_key, {c}_v AS {c} FROM (SELECT stage_key, mesh_key, {c}_k, arg_max({c}_v, (coalesce(t, '-inf'::DOUBLE), record_id)) AS {c}_v, round(log2(sum(d * CASE WHEN ok THEN {"pow(2.0::DOUBLE, 256)" if c == "error" else "2.0::DOUBLE"} ELSE 1.0::DOUBLE END)), 9) AS s, max((coalesce(t, '-inf'::DOUBLE), record_id)) AS o FROM (SELECT *, {x} AS {c}_k, {_AT.format(c) if c == "started_at" else x if c == "error" else c} AS {c}_v FROM w) WHERE {c}_v IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY stage_key, mesh_key ORDER BY s DESC, o DESC) = 1)"""
        for c, x in _VOTED.items()
    )
    + "\nSELECT run.*, "
    + ", ".join("nullif(error, '') AS error" if c == "error" else c for c in _VOTED)
    + " FROM run "
    + " ".join(f"LEFT JOIN v_{c} USING (stage_key, mesh_key)" for c in _VOTED)
)

ORACLE = {
    "p1_survivors": _SURVIVORS,
    "p3_cutoffs": f"""
WITH l AS (SELECT state_id, max_by(score, scored_at) AS score, max_by(source, scored_at) AS source FROM (SELECT state_id, coalesce(score, 'nan'::DOUBLE) AS score, source, scored_at FROM gate_score) GROUP BY 1),
c AS (SELECT score, {_key("source")} AS source FROM l WHERE isfinite(score)),
t AS (SELECT {_key("source")} AS source, CASE WHEN target_open_rate > 1 THEN target_open_rate / 100 ELSE target_open_rate END AS target FROM gate_target),
x AS (SELECT source, score, target, count(*) OVER (PARTITION BY source ORDER BY score DESC) AS kept, count(*) OVER (PARTITION BY source) AS states FROM c JOIN t USING (source))
SELECT source, max(score) AS cutoff, min(kept) AS kept, any_value(states) AS states, min(kept) / any_value(states) AS kept_share, any_value(target) AS target FROM x WHERE kept / states >= target GROUP BY 1""",
    "p4_daily_histograms": _HIST + " SELECT category, stage, day, metric, count(*) AS buckets, sum(n) AS n, string_agg(bucket || ':' || n, ' ' ORDER BY bucket) AS histogram FROM h GROUP BY 1, 2, 3, 4",
    "p4_signed_changes": _pct(_SIGNED, "category", (0.05, 0.25, 0.5, 0.75, 0.95), 9),
    "p4_percentiles": _PCT,
    "p4_merged_from_days": _PCT,
    "p7_report": f"""
WITH n AS (SELECT floor(count(DISTINCT eval_id) / 5) AS size FROM evaluation_record),
u AS (SELECT DISTINCT eval_id, {_CAT} AS c FROM evaluation_record WHERE {_OK.format("status")}),
k AS (SELECT c, count(DISTINCT eval_id) AS have FROM u GROUP BY 1),
w AS (SELECT category, target_share, min_rows, CAST(ceil(greatest(target_share * size, min_rows) - 1e-9) AS BIGINT) AS wanted, coalesce(have, 0) AS available FROM sample_target t LEFT JOIN k ON {_CAT.replace("category", "t.category")} = k.c, n)
SELECT category, target_share, min_rows, wanted, available, least(wanted, available) AS drawn, least(wanted, available) / sum(least(wanted, available)) OVER () AS actual_share, greatest(0, wanted - available) AS short FROM w""",
    "p1_found": f"""
WITH r AS (SELECT record_id, coalesce({_key("stage")}, '') AS s, coalesce({_key("mesh_id")}, '') AS m, coalesce({_OK.format("status")}, false) AS ok,
  CASE WHEN finished_at > 0 AND NOT isnan(finished_at) THEN CASE WHEN finished_at < 1e11 THEN finished_at WHEN finished_at < 1e14 THEN finished_at / 1e3 ELSE finished_at / 1e6 END END AS t FROM stage_record)
SELECT record_id FROM r QUALIFY row_number() OVER (PARTITION BY s, m ORDER BY ok DESC, t DESC NULLS LAST, record_id DESC) > 1""",
    "p2_found": _TIED + "SELECT DISTINCT x AS mesh_no_a, y AS mesh_no_b FROM r WHERE x < y",
    "p2_members": _TIED + "SELECT m.mesh_no, least(m.mesh_no, coalesce(min(y), m.mesh_no)) AS component FROM m LEFT JOIN r ON m.mesh_no = r.x GROUP BY 1",
    "p3_found": f"""
WITH l AS (SELECT state_id, max_by(score, scored_at) AS score, max_by(source, scored_at) AS source FROM (SELECT state_id, coalesce(score, 'nan'::DOUBLE) AS score, source, scored_at FROM gate_score) GROUP BY 1),
c AS (SELECT state_id, score, {_key("source")} AS s FROM l WHERE isfinite(score)),
t AS (SELECT {_key("source")} AS s, CASE WHEN target_open_rate > 1 THEN target_open_rate / 100 ELSE target_open_rate END AS want FROM gate_target),
x AS (SELECT c.*, want, count(*) OVER (PARTITION BY s ORDER BY score DESC) / count(*) OVER (PARTITION BY s) AS share FROM c JOIN t USING (s)),
k AS (SELECT s, max(score) AS cut FROM x WHERE share >= want GROUP BY 1)
SELECT state_id FROM c JOIN k USING (s) WHERE score >= cut""",
    "p7_found": f"""
WITH n AS (SELECT floor(count(DISTINCT eval_id) / 5) AS size FROM evaluation_record),
u AS (SELECT DISTINCT eval_id, {_CAT} AS c FROM evaluation_record WHERE {_OK.format("status")}),
k AS (SELECT c, count(DISTINCT eval_id) AS have FROM u GROUP BY 1)
SELECT category FROM sample_target t LEFT JOIN k ON {_CAT.replace("category", "t.category")} = k.c, n WHERE coalesce(have, 0) < greatest(target_share * size, min_rows)""",
}
