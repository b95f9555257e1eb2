"""Queries for sources and sinks (S1-S9), projections / null handling
and filters (F1-F3)."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from sluice.functions.labels import TOXIC_THRESHOLD
from sluice.operators.labels import loss_weight
from sluice.operators.metrics import loss_by_name, roc_auc
from sluice.operators.sampling import training_labels
from sluice.plans import sqltext as S
from sluice.plans.q_scoring import MODEL_SQL, MODELS, VIEW_SQL, file_scores, model_scores
from sluice.plans.registry import register
from sluice.session import materialize, scratch_path
from sluice.sources import commits as CM
from sluice.sources import csv_io as C
from sluice.sources import registry as REG
from sluice.sources import tables as T

DOC_SCHEMA = TY.StructType([
    TY.StructField("doc_id", TY.LongType()), TY.StructField("text", TY.StringType()),
    TY.StructField("lang", TY.StringType()), TY.StructField("source", TY.StringType()),
    TY.StructField("n_chars", TY.LongType())])


def _docs_csv(spark, sf_dir) -> str:
    """Land ``documents`` as CSV (one part per task) in the scratch folder."""
    path = scratch_path(spark, "documents-csv")
    return C.write_csv(T.table(spark, sf_dir, "documents"), path)


@register("csv_scan", sql="SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_scan(spark, sf_dir):
    return C.read_csv(spark, _docs_csv(spark, sf_dir), DOC_SCHEMA)


@register("csv_scan_pruned", sql="SELECT doc_id, text FROM documents")
def csv_scan_pruned(spark, sf_dir):
    return C.read_csv(spark, _docs_csv(spark, sf_dir), DOC_SCHEMA, columns=["doc_id", "text"])


@register("csv_scan_keyed", sql="SELECT doc_id, text, lang FROM documents")
def csv_scan_keyed(spark, sf_dir):
    df = C.read_csv(spark, _docs_csv(spark, sf_dir), DOC_SCHEMA, columns=["doc_id", "text", "lang"])
    return C.assert_unique(df, "doc_id")


# --- the catalogue: the driver's tables landed by path, as a user's tables would be --------

_LABELLED = "id bigint, comment_text string, toxic double"
_S2018 = {"train_2018_es": 3, "train_2018_other": 7}  # stand-ins: comments by the last digit of their id


def _landed(spark, sf_dir) -> dict[str, tuple]:
    """name -> (rows to land, schema, renames, role, format)."""
    c = T.comments(spark, sf_dir)
    s1, s2, v = T.set1(spark, sf_dir), T.soft_set2(spark, sf_dir), T.valid(spark, sf_dir)
    test = T.test_table(spark, sf_dir)
    keyed = "id bigint, comment_text string, toxic double, lang string"
    merged = s1.select("id", "comment_text", "toxic").unionByName(training_labels(s2).select("id", "comment_text", "toxic"))
    out = {"train_merged": (merged, _LABELLED, {}, "train", "parquet"),
           "train_set1": (s1, _LABELLED, {}, "train", "csv"), "train_set2": (s2, _LABELLED, {}, "train", "csv")}
    out |= {n: (c.filter(F.col("id") % 10 == d), _LABELLED, {}, "train", "csv") for n, d in _S2018.items()}
    out |= {f"{n}_processed": (out[n][0], _LABELLED, {}, "train", "parquet") for n in _S2018}
    out |= {
        "validation": (v, keyed, {}, "valid", "csv"),
        "valid_en1": (v.withColumnRenamed("comment_text", "comment_text_en"), "id bigint, comment_text_en string, toxic double",
                      {"comment_text_en": "comment_text"}, "valid", "csv"),
        "valid_en2": (v.select("id", F.lower("comment_text").alias("translated"), "toxic"), "id bigint, translated string, toxic double",
                      {"translated": "comment_text"}, "valid", "csv"),
        "valid_en3": (v, _LABELLED, {}, "valid", "parquet"),
        "test": (test, "id bigint, content string, lang string", {"content": "comment_text"}, "test", "csv"),
        "test_en1": (test.withColumnRenamed("content", "content_en"), "id bigint, content_en string", {"content_en": "comment_text"}, "test", "csv"),
        "test_en2": (test.select("id", F.lower("content").alias("translated")), "id bigint, translated string", {"translated": "comment_text"}, "test", "parquet"),
        "sample_submission": (test.select("id", F.lit(0.5).alias("toxic")), "id bigint, toxic double", {}, "template", "csv"),
        "pool": (T.pool_source(spark, sf_dir), keyed, {}, "pool", "parquet")}
    return out


def landed_catalog(spark, sf_dir, names=None) -> REG.Catalog:
    """Write the named tables (all by default) to the shared folder and register them by path."""
    catalog = REG.Catalog()
    for name, (rows, ddl, renames, role, fmt) in _landed(spark, sf_dir).items():
        if names is None or name in names:
            path, rows = scratch_path(spark, name), rows.select(*REG.schema_of(ddl).names)
            if fmt == "csv":
                C.write_csv(rows, path)
            else:
                rows.write.parquet(path)
            catalog.register(name, path, ddl, renames, role, fmt)
    return catalog


def _registry_sql() -> str:
    v, s1, s2, c = S.VALID, S.SET1, S.SET2, S.COMMENTS
    of = {"train_merged": f"(SELECT id FROM {s1} a UNION ALL SELECT id FROM {s2} b)", "train_set1": s1, "train_set2": s2, "validation": v,
          "valid_en1": v, "valid_en2": v, "valid_en3": v, "pool": "conversations", "test": "documents", "test_en1": "documents",
          "test_en2": "documents", "sample_submission": "documents"}
    for n, d in _S2018.items():
        of[n] = of[f"{n}_processed"] = f"(SELECT id FROM {c} q WHERE id % 10 = {d})"
    return "\nUNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {t} x" for n, t in of.items())


@register("dataset_registry", sql=_registry_sql())
def dataset_registry(spark, sf_dir):
    catalog = landed_catalog(spark, sf_dir)
    parts = [catalog.load(spark, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in catalog]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _selected(variant: str, parts: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT comment_text, toxic, '{n}' AS source FROM {t} t" for n, t in parts.items())
    return (f"SELECT '{variant}' AS variant, source, count(*) AS n_rows, round(sum(toxic), 6) AS sum_toxic, "
            f"CAST(sum(length(comment_text)) AS BIGINT) AS n_chars FROM ({rows}) u GROUP BY source")


_BIN2 = f"(SELECT comment_text, CAST(toxic >= 0.95 AS INTEGER) AS toxic FROM {S.soft_set2()} b)"
_FLOOR2 = f"(SELECT comment_text, CASE WHEN toxic >= 0.95 THEN toxic ELSE 0.0 END AS toxic FROM {S.soft_set2()} b)"
_2018 = {n: f"(SELECT * FROM {S.COMMENTS} q WHERE id % 10 = {d})" for n, d in _S2018.items()}


@register("select_sources", sql="\nUNION ALL ".join([
    _selected("default", {"train_set1": S.SET1, "train_set2": _BIN2}),
    _selected("extra", {"train_set1": S.SET1, **_2018, "train_set2": _BIN2}),
    _selected("float_labels", {"train_set1": S.SET1, "train_set2": _FLOOR2}),
    _selected("merged", {"train_merged": f"(SELECT comment_text, toxic FROM {S.SET1} a UNION ALL SELECT * FROM {_BIN2} c)"})]))
def select_sources(spark, sf_dir):
    catalog = landed_catalog(spark, sf_dir, {REG.MERGED, REG.SET1, REG.SET2, *REG.EXTRA})
    variants = {"default": {}, "extra": {"extra": True}, "float_labels": {"float_labels": True}, "merged": {"merged": True}}
    parts = [REG.select_sources(catalog, spark, **flags).withColumn("variant", F.lit(v)) for v, flags in variants.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.groupBy("variant", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("toxic"), 6).alias("sum_toxic"),
                                              F.sum(F.length("comment_text")).cast("bigint").alias("n_chars"))


def _submission(spark, sf_dir):
    from sluice.plans.q_scoring import submission_join
    return submission_join(spark, sf_dir).select("id", "toxic")


@register("submission_sink", sql=f"""
WITH {VIEW_SQL}, s AS (SELECT id, avg(logit) AS toxic FROM views GROUP BY id)
SELECT d.doc_id AS id, round(s.toxic, 9) AS toxic FROM documents d LEFT JOIN s ON d.doc_id = s.id
""")
def submission_sink(spark, sf_dir):
    path = C.write_csv(_submission(spark, sf_dir), scratch_path(spark, "submission"))
    schema = TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("toxic", TY.DoubleType())])
    return C.read_csv(spark, path, schema)


@register("part_submissions", sql="SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, 0::BIGINT AS n_empty_parts FROM documents")
def part_submissions(spark, sf_dir):
    # every writing task leaves its own uniquely named part file; together they hold every id once
    path = C.write_csv(_submission(spark, sf_dir), scratch_path(spark, "node-submissions"))
    schema = TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("toxic", TY.DoubleType())])
    rows = C.part_files(C.read_csv(spark, path, schema))
    parts = rows.groupBy("part_file").agg(F.count("toxic").alias("n"))
    return rows.agg(F.count("toxic").alias("n_rows"), F.countDistinct("id").alias("n_ids")).withColumn(
        "n_empty_parts", parts.agg(F.count_if(F.col("n") == 0)).scalar())


@register("resumable_parts", sql=f"""
WITH {VIEW_SQL}, s AS (SELECT id, avg(logit) AS toxic FROM views WHERE view = 'orig' GROUP BY id)
SELECT id, round(toxic, 9) AS toxic FROM s
""")
def resumable_parts(spark, sf_dir):
    """A run that stops after its first files, and a second one that scores only the others."""
    path = scratch_path(spark, "resumable")
    T.test_table(spark, sf_dir).repartition(6, "id").write.parquet(f"{path}/input")
    files = spark.read.parquet(f"{path}/input")
    some = files.sparkSession.read.parquet(*files.inputFiles()[:2])
    first = CM.score_files(some, file_scores, f"{path}/out", wave=1)
    second = CM.score_files(files, file_scores, f"{path}/out", wave=3)
    if first + second != len(files.inputFiles()):
        raise ValueError("a file was scored twice")
    return CM.scored_rows(spark, f"{path}/out", "id long, toxic double").withColumn("toxic", F.round("toxic", 9))


@register("per_model_sink", sql=MODEL_SQL)
def per_model_sink(spark, sf_dir):
    """Three models over two views, one CSV folder for each model, read back."""
    rows = model_scores(spark, sf_dir).withColumn("toxic", F.round("toxic", 9))
    path = C.write_partitioned(rows, scratch_path(spark, "per-model"), "model", "csv")
    schema = TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("toxic", TY.DoubleType())])
    parts = [C.read_csv(spark, f"{path}/model={m}", schema).withColumn("model", F.lit(m)) for m in MODELS]
    return reduce(lambda a, b: a.unionByName(b), parts).select("model", "id", "toxic")


LOG_KEYS = ["run", "epoch", "split"]


def log_metrics(spark, path: str, rows, run: str, split: str, loss: str = "weighted_bce") -> None:
    """Put a split's loss and AUC per epoch into the log at ``path``, and the seconds that they took; a repeated call leaves one row each."""
    started = time.time()
    losses = loss_by_name(loss, rows, "x", "y", "w", ["epoch"])
    done = materialize(losses.join(roc_auc(rows, "y", "score", ["epoch"]).select("epoch", "auc"), "epoch"))
    seconds = time.time() - started  # of this split's job, which has run by now
    CM.append_log(done.select(F.lit(run).alias("run"), "epoch", F.lit(split).alias("split"), "loss", F.col("auc").alias("score"),
                              F.lit(seconds).alias("seconds")), path, LOG_KEYS)


def _log_sql(split: str, rest: int) -> str:
    rows = f"(SELECT step // 25 + 1 AS epoch, y, score, (loss - 250.0) / 50.0 AS x FROM {S.METRIC_ROWS} m WHERE step % 2 = {rest})"
    return f"""SELECT l.epoch, '{split}' AS split, l.loss, a.auc AS score FROM (
  SELECT epoch, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 9) AS loss FROM {rows} r GROUP BY epoch) l
JOIN (SELECT epoch, round((sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 9) AS auc
      FROM (SELECT epoch, y, rank() OVER (PARTITION BY epoch ORDER BY score)
                   + (count(*) OVER (PARTITION BY epoch, score) - 1) / 2.0 AS ar FROM {rows} r) k GROUP BY epoch) a USING (epoch)"""


@register("metric_log", sql=_log_sql("train", 0) + "\nUNION ALL " + _log_sql("valid", 1))
def metric_log(spark, sf_dir):
    """The log of two splits; the table also has the seconds, which no SQL can tell."""
    m = T.metric_rows(spark, sf_dir).withColumn("epoch", (F.col("step") / 25).cast("bigint") + 1)
    m = m.withColumn("x", (F.col("loss") - 250.0) / 50.0).withColumn("w", F.lit(1.0))
    path = scratch_path(spark, "metric-log")
    # the first split is logged twice, as by a run that was taken up again
    for rest, split in ((0, "train"), (1, "valid"), (0, "train")):
        log_metrics(spark, path, m.filter(F.col("step") % 2 == rest), "r1", split)
    log = CM.read_log(spark, path, "run string, epoch long, split string, loss double, score double, seconds double")
    return log.select("epoch", "split", F.round("loss", 9).alias("loss"), F.round("score", 9).alias("score"))


# --- projections and null handling -------------------------------------------------

@register("rename_to_common", sql=f"""
SELECT id, comment_text, toxic, 'valid_en1' AS view FROM {S.VALID} a
UNION ALL SELECT id, lower(comment_text), toxic, 'valid_en2' FROM {S.VALID} b
""")
def rename_to_common(spark, sf_dir):
    catalog = landed_catalog(spark, sf_dir, {"valid_en1", "valid_en2"})
    a, b = (catalog.load(spark, n).withColumn("view", F.lit(n)) for n in catalog)
    return a.unionByName(b).select("id", "comment_text", "toxic", "view")


@register("project_cols", sql=f"SELECT comment_text, toxic, lang FROM {S.COMMENTS} c")
def project_cols(spark, sf_dir):
    return T.comments(spark, sf_dir).select("comment_text", "toxic", "lang")


NULLS = f"(SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE comment_text END AS comment_text, toxic FROM {S.COMMENTS} c)"


@register("fill_text_none", sql=f"SELECT id, coalesce(comment_text, 'none') AS comment_text, toxic FROM {NULLS} n")
def fill_text_none(spark, sf_dir):
    n = T.null_fixture(spark, sf_dir).select("id", "comment_text", "toxic")
    return n.fillna({"comment_text": "none"})


@register("fill_zero", sql=f"""
SELECT id, coalesce(CASE WHEN id % 7 = 0 THEN NULL ELSE toxic END, 0.0) AS toxic,
       coalesce(CASE WHEN id % 7 = 0 THEN NULL WHEN toxic = 0 THEN 0.9 ELSE toxic END, 0.0) AS weight
FROM {S.COMMENTS} c
""")
def fill_zero(spark, sf_dir):
    c = T.comments(spark, sf_dir).withColumn(
        "toxic", F.when(F.col("id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("toxic")))
    w = loss_weight(c, mode="constant")
    return w.select("id", "toxic", "weight").fillna({"toxic": 0.0, "weight": 0.0})


# --- filters -------------------------------------------------------------------------

@register("filter_toxic_ge", sql=f"SELECT id, toxic FROM {S.soft_set2()} s WHERE toxic >= 0.95")
def filter_toxic_ge(spark, sf_dir):
    return T.soft_set2(spark, sf_dir).filter(F.col("toxic") >= TOXIC_THRESHOLD).select("id", "toxic")


@register("filter_toxic_eq", sql=f"""
SELECT id, toxic, 'pos' AS side FROM {S.COMMENTS} a WHERE toxic = 1
UNION ALL SELECT id, toxic, 'neg' FROM {S.COMMENTS} b WHERE toxic = 0
""")
def filter_toxic_eq(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    return (c.filter(F.col("toxic") == 1).select("id", "toxic", F.lit("pos").alias("side"))
            .unionByName(c.filter(F.col("toxic") == 0).select("id", "toxic", F.lit("neg").alias("side"))))


@register("filter_not_null", sql=f"SELECT id, comment_text FROM {NULLS} n WHERE comment_text IS NOT NULL")
def filter_not_null(spark, sf_dir):
    return T.null_fixture(spark, sf_dir).filter(F.col("comment_text").isNotNull()).select("id", "comment_text")
