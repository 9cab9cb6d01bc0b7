"""Queries over run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions.text import category_key, is_success, name_key
from meshquarry.operators import manifest as M
from meshquarry.session import maybe_broadcast, table

S_ = SparkSession
KEYS = ("stage", "category", "mesh_id")
METRICS = ("num_box", "bvs", "mov", "tov", "covered", "viou", "cub_cd", "elapsed_sec")


def _records(spark: S_, d: str) -> DataFrame:
    return table(spark, d, "stage_record")


def _latest(spark: S_, d: str) -> DataFrame:
    r = _records(spark, d).select(*KEYS, "status", "finished_at", "record_id")
    return M.latest(r, KEYS, [F.col("finished_at"), F.col("record_id")])


def latest_records(spark: S_, d: str) -> DataFrame:
    """Latest record per stage, category and mesh as written; of equal times the last read."""
    return _latest(spark, d)


def latest_successes(spark: S_, d: str) -> DataFrame:
    """Latest success per category and mesh, with the record at which the key first appears."""
    r = _records(spark, d).select("category", "mesh_id", "status", "finished_at", "record_id")
    return M.latest_success(r, ("category", "mesh_id"), [F.col("finished_at"), F.col("record_id")], seq="record_id").select("category", "mesh_id", "record_id", "first_seq")


def status_by_stage(spark: S_, d: str) -> DataFrame:
    """Records by stage and status."""
    return M.status_counts(_records(spark, d))


def status_by_stage_latest(spark: S_, d: str) -> DataFrame:
    """The same over the latest record of each key."""
    return M.status_counts(_latest(spark, d))


def evaluation_summary(spark: S_, d: str) -> DataFrame:
    """Counts and mean metrics of the successes of each stage as written."""
    return M.metric_summary(table(spark, d, "evaluation_record"), METRICS, ["stage"])


def batch_summary(spark: S_, d: str) -> DataFrame:
    """Per stage key: runs, time in all, mean and longest, the slowest mesh (first on ties), share of successes."""
    e = table(spark, d, "evaluation_record").select(name_key(F.col("stage")).alias("stage"), "mesh_id", "elapsed_sec", "eval_id", is_success(F.col("status")).alias("ok"))
    slow = F.max_by("mesh_id", F.struct("elapsed_sec", (-F.col("eval_id")).alias("e")))
    return e.filter(F.col("elapsed_sec").isNotNull()).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_sec"), 3).alias("total_sec"), F.round(F.avg("elapsed_sec"), 6).alias("avg_sec"), F.max("elapsed_sec").alias("max_sec"), slow.alias("slowest_mesh"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))


def failure_histogram(spark: S_, d: str) -> DataFrame:
    """Failed records by stage and failure class."""
    r = _records(spark, d).select("stage", M.failure_class(F.col("error"), F.col("status")).alias("failure_class"))
    return r.filter(F.col("failure_class").isNotNull()).groupBy("stage", "failure_class").agg(F.count("*").alias("n"))


def slowest_meshes(spark: S_, d: str) -> DataFrame:
    """The three slowest evaluations of each stage."""
    e = table(spark, d, "evaluation_record").select("eval_id", name_key(F.col("stage")).alias("stage"), "mesh_id", "elapsed_sec").filter(F.col("elapsed_sec").isNotNull()).distinct()
    return M.top_per_group(e, ["stage"], [F.desc("elapsed_sec"), F.asc("eval_id")], 3)


def resume_plan(spark: S_, d: str) -> DataFrame:
    """Stage and mesh keys still to run: seen in the manifest but without any success."""
    r = _records(spark, d).select(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh"), is_success(F.col("status")).alias("ok"))
    return r.groupBy("stage", "mesh").agg(F.bool_or("ok").alias("done")).filter(~F.col("done")).select("stage", "mesh")


def evaluated_models(spark: S_, d: str) -> DataFrame:
    """Models with a successful evaluation (J18), by category: how many, and how many are left out."""
    done = table(spark, d, "evaluation_record").filter(is_success(F.col("status"))).select(name_key(F.col("mesh_id")).alias("key")).distinct()
    m = table(spark, d, "mesh_model").select("category", name_key(F.col("mesh_id")).alias("key"))
    j = m.join(done.withColumn("hit", F.lit(1)), "key", "left")
    return j.groupBy("category").agg(F.count("hit").alias("evaluated"), F.count_if(F.col("hit").isNull()).alias("left_out"))


def records_with_metrics(spark: S_, d: str) -> DataFrame:
    """Latest stage records joined to evaluations of the same stage and mesh; those without one are counted."""
    e = table(spark, d, "evaluation_record").select(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh"), "eval_id").groupBy("stage", "mesh").agg(F.countDistinct("eval_id").alias("evals"))
    r = _records(spark, d).select(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh")).distinct()
    return r.join(e, ["stage", "mesh"], "left").groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(F.col("evals").isNull()).alias("without"), F.coalesce(F.sum("evals"), F.lit(0)).alias("evals"))


def newest_artefact(spark: S_, d: str) -> DataFrame:
    """Newest output path per mesh and stage key, of those finished since an instant."""
    r = _records(spark, d).filter(F.col("output_path").isNotNull() & (F.col("finished_at") >= 1735689600))
    return r.groupBy(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh")).agg(F.max_by("output_path", F.struct("finished_at", "output_path")).alias("output_path"), F.max("finished_at").alias("finished_at"))


def data_status(spark: S_, d: str) -> DataFrame:
    """Models and manifest rows by category key."""
    m = table(spark, d, "mesh_model").groupBy(category_key(F.col("category")).alias("category")).agg(F.count("*").alias("models"), F.sum(F.col("vertex_count").cast("long")).alias("vertices"), F.min("mesh_id").alias("first_mesh"))
    r = _records(spark, d).groupBy(category_key(F.col("category")).alias("category")).agg(F.count("*").alias("records"))
    return m.join(r, "category", "full").select("category", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("models", "vertices", "records")), "first_mesh").filter(F.col("category").isNotNull())


def score_lookup(spark: S_, d: str) -> DataFrame:
    """Mean score by (source, category), falling back to the source's, then to the overall mean where fewer than five support it."""
    g = table(spark, d, "gate_score").filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))))
    fine = g.groupBy("source", "category").agg(F.count("*").alias("support"), F.avg("score").alias("fine"))
    mid = g.groupBy("source").agg(F.count("*").alias("n_source"), F.avg("score").alias("mid"))
    all_ = float(g.agg(F.avg("score").alias("m")).first().m or 0.0)
    j = fine.join(maybe_broadcast(mid), "source")
    value = F.when(F.col("support") >= 5, F.col("fine")).when(F.col("n_source") >= 5, F.col("mid")).otherwise(F.lit(all_))
    level = F.when(F.col("support") >= 5, "pair").when(F.col("n_source") >= 5, "source").otherwise("all")
    return j.select("source", "category", "support", level.alias("level"), F.round(value, 6).alias("value"))


def metadata_values(spark: S_, d: str) -> DataFrame:
    """Back end and attempts read from the records' JSON metadata."""
    m = _records(spark, d).select(name_key(F.col("stage")).alias("stage"), F.get_json_object("metadata", "$.backend").alias("backend"), F.expr("try_cast(get_json_object(metadata, '$.attempts') AS INT)").alias("attempts"))
    return m.groupBy("stage", "backend").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


QUERIES = {f.__name__: f for f in (latest_records, latest_successes, status_by_stage, status_by_stage_latest, evaluation_summary, batch_summary, failure_histogram, slowest_meshes, resume_plan, evaluated_models, records_with_metrics, newest_artefact, data_status, score_lookup, metadata_values)}

K = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({c}), e' \t\r\n'), '^.*[/\\]', ''), '\.(obj|off|ply|stl|msh|json|jsonl|csv|tsv|txt|parquet|log)$', ''), '[^\pL\pN]+', '', 'g')"
OK = "regexp_replace(lower({}), '[^\\pL\\pN]+', '', 'g') IN ('success','succeeded','ok')"
CAT = lambda c: f"nullif(nullif(regexp_replace({K(c)}, '^shapenet', ''), ''), 'unknown')"
_LATEST = "l AS (SELECT stage, category, mesh_id, status, finished_at, record_id FROM stage_record QUALIFY row_number() OVER (PARTITION BY stage, category, mesh_id ORDER BY finished_at DESC NULLS LAST, record_id DESC) = 1)"
_TEXT = "lower(coalesce(error, ''))"

ORACLE = {
    "latest_records": f"WITH {_LATEST} SELECT * FROM l",
    "latest_successes": "SELECT category, mesh_id, record_id, min(record_id) OVER (PARTITION BY category, mesh_id) AS first_seq FROM stage_record WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY category, mesh_id ORDER BY finished_at DESC NULLS LAST, record_id DESC) = 1",
    "status_by_stage": "SELECT stage, status, count(*) AS n FROM stage_record GROUP BY 1, 2",
    "status_by_stage_latest": f"WITH {_LATEST} SELECT stage, status, count(*) AS n FROM l GROUP BY 1, 2",
    "evaluation_summary": "SELECT stage, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status IS DISTINCT FROM 'success') AS failed, " + ", ".join(f"round(avg({m}) FILTER (WHERE status = 'success' AND isfinite({m})), 6) AS avg_{m}" for m in METRICS) + " FROM evaluation_record GROUP BY 1",
    "batch_summary": f"SELECT {K('stage')} AS stage, count(*) AS n, round(sum(elapsed_sec), 3) AS total_sec, round(avg(elapsed_sec), 6) AS avg_sec, max(elapsed_sec) AS max_sec, arg_max(mesh_id, (elapsed_sec, -eval_id)) AS slowest_mesh, round(avg(CASE WHEN {OK.format('status')} THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM evaluation_record WHERE elapsed_sec IS NOT NULL GROUP BY 1",
    "failure_histogram": "SELECT stage, CASE WHEN " + f"{_TEXT} = '' THEN 'no_message' " + " ".join("WHEN " + " OR ".join(f"contains({_TEXT}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in M.FAILURE_RULES) + " ELSE 'unknown' END AS failure_class, count(*) AS n FROM stage_record WHERE lower(trim(status)) IN ('failed', 'error', 'timeout') GROUP BY 1, 2",
    "slowest_meshes": f"WITH e AS (SELECT DISTINCT eval_id, {K('stage')} AS stage, mesh_id, elapsed_sec FROM evaluation_record WHERE elapsed_sec IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY stage ORDER BY elapsed_sec DESC, eval_id) AS rank FROM e QUALIFY rank <= 3",
    "resume_plan": f"SELECT {K('stage')} AS stage, {K('mesh_id')} AS mesh FROM stage_record GROUP BY 1, 2 HAVING NOT bool_or(coalesce({OK.format('status')}, false))",
    "evaluated_models": f"WITH d AS (SELECT DISTINCT {K('mesh_id')} AS key FROM evaluation_record WHERE {OK.format('status')}) SELECT category, count(d.key) AS evaluated, count(*) - count(d.key) AS left_out FROM (SELECT category, {K('mesh_id')} AS key FROM mesh_model) m LEFT JOIN d USING (key) GROUP BY 1",
    "records_with_metrics": f"WITH e AS (SELECT {K('stage')} AS stage, {K('mesh_id')} AS mesh, count(DISTINCT eval_id) AS evals FROM evaluation_record GROUP BY 1, 2), r AS (SELECT DISTINCT {K('stage')} AS stage, {K('mesh_id')} AS mesh FROM stage_record) SELECT stage, count(*) AS runs, count(*) - count(evals) AS without, coalesce(sum(evals), 0) AS evals FROM r LEFT JOIN e USING (stage, mesh) GROUP BY 1",
    "newest_artefact": f"SELECT {K('stage')} AS stage, {K('mesh_id')} AS mesh, arg_max(output_path, (finished_at, output_path)) AS output_path, max(finished_at) AS finished_at FROM stage_record WHERE output_path IS NOT NULL AND finished_at >= 1735689600 GROUP BY 1, 2",
    "data_status": f"WITH m AS (SELECT {CAT('category')} AS category, count(*) AS models, sum(vertex_count) AS vertices, min(mesh_id) AS first_mesh FROM mesh_model GROUP BY 1), r AS (SELECT {CAT('category')} AS category, count(*) AS records FROM stage_record GROUP BY 1) SELECT category, coalesce(models, 0) AS models, coalesce(vertices, 0) AS vertices, coalesce(records, 0) AS records, first_mesh FROM m FULL JOIN r USING (category) WHERE category IS NOT NULL",
    "score_lookup": "WITH g AS (SELECT * FROM gate_score WHERE isfinite(score)), f AS (SELECT source, category, count(*) AS support, avg(score) AS fine FROM g GROUP BY 1, 2), m AS (SELECT source, count(*) AS n_source, avg(score) AS mid FROM g GROUP BY 1), a AS (SELECT avg(score) AS al FROM g) SELECT source, category, support, CASE WHEN support >= 5 THEN 'pair' WHEN n_source >= 5 THEN 'source' ELSE 'all' END AS level, round(CASE WHEN support >= 5 THEN fine WHEN n_source >= 5 THEN mid ELSE al END, 6) AS value FROM f JOIN m USING (source), a",
    "metadata_values": f"SELECT {K('stage')} AS stage, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.backend') END AS backend, count(*) AS n, sum(try_cast(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.attempts') END AS INT)) AS attempts FROM stage_record GROUP BY 1, 2",
}
