"""Batch scoring, view ensembles, submissions and model fitting."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.labels import binarise
from sluice.functions.scoring import linear_head
from sluice.operators import solver
from sluice.operators.labels import loss_weight
from sluice.operators.metrics import loss_by_name, roc_auc
from sluice.session import materialize


def batch_score(df: DataFrame, key, vec_col: str, weights: Sequence[float], bias: float,
                out_col: str = "logit") -> DataFrame:
    """Q3: score rows in Arrow batches with a model set up once per task.

    ``mapInPandas`` hands each task an iterator of Arrow record batches (size
    ``spark.sql.execution.arrow.maxRecordsPerBatch``); the scorer is built
    once per iterator and applied to a whole batch as one matrix product.
    The key column(s) pass through, so output is keyed, never positional.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = np.asarray(list(weights), dtype=np.float64)
    b = float(bias)
    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def score_partition(batches):
        coef = w  # model state: built once per task, reused for every batch
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col].to_numpy()])
            out = pdf[keys].copy()
            out[out_col] = x @ coef + b
            yield out

    return df.select(*keys, vec_col).mapInPandas(score_partition, f"{key_schema}, {out_col} double")


def score_arrays(df: DataFrame, key: str, vec_col: str, weights: Sequence[float], bias: float) -> DataFrame:
    """Scorer output in the model's ``[batch, 1]`` shape: one 1-element array per row."""
    s = batch_score(df, key, vec_col, weights, bias)
    return s.select(key, F.array("logit").alias("logits"))


def flatten_scores(df: DataFrame, key: str, arr_col: str, out_col: str = "logit") -> DataFrame:
    """Flatten per-row score lists (``explode``), keeping the key."""
    return df.select(key, F.explode(arr_col).alias(out_col))


def views_from_columns(df: DataFrame, key: str, view_cols: Mapping[str, object],
                       out_col: str = "features") -> DataFrame:
    """Long ``(key, view, out_col)`` from one scan that computes every view
    side by side (one read of the source instead of one per view). Compute
    per-row features *after* this step, on the single long column, so that
    an expensive view expression is evaluated once per row."""
    packed = F.array(*[F.struct(F.lit(name).alias("view"), col.alias(out_col))
                       for name, col in view_cols.items()])
    return df.select(key, F.explode(packed).alias("_v")).select(key, "_v.view", f"_v.{out_col}")


def score_views(long_views: DataFrame, key: str, vec_col: str, weights: Sequence[float],
                bias: float) -> DataFrame:
    """Q4 on a long ``(key, view, vec)`` table: one scoring pass, as a built-in expression."""
    return long_views.select(key, "view", linear_head(vec_col, weights, bias).alias("logit"))


def score_models(long_views: DataFrame, key: str, vec_col: str,
                 models: Mapping[str, tuple[Sequence[float], float]]) -> DataFrame:
    """Every model on every view in one pass: long ``(model, key, view, logit)``."""
    scored = F.array(*[F.struct(F.lit(name).alias("model"), linear_head(vec_col, w, b).alias("logit"))
                       for name, (w, b) in models.items()])
    return long_views.select(key, "view", F.explode(scored).alias("_m")).select("_m.model", key, "view", "_m.logit")


def ensemble_join(long_scores: DataFrame, key: str, views: Sequence[str]) -> DataFrame:
    """One row per key with a column per view (inner equi-join semantics)."""
    wide = long_scores.groupBy(key).pivot("view", list(views)).agg(F.first("logit"))
    cond = None
    for v in views:
        c = F.col(v).isNotNull()
        cond = c if cond is None else cond & c
    return wide.filter(cond).select(key, *[F.col(v).alias(f"p_{v}") for v in views])


def ensemble_mean(long_scores: DataFrame, key, out_col: str = "toxic") -> DataFrame:
    """A4: mean of the views' raw logits per key(s) (``groupBy`` with partial aggregation)."""
    keys = [key] if isinstance(key, str) else list(key)
    return long_scores.groupBy(*keys).agg(F.avg("logit").alias(out_col))


def submission_join(template: DataFrame, scores: DataFrame, key: str = "id",
                    score_col: str = "toxic") -> DataFrame:
    """Put scores onto the submission template by key; a template
    row without a score fails the query (instead of a silent misalignment)."""
    t = template.drop(score_col) if score_col in template.columns else template
    return _with_scores(t, scores, key, score_col).select(*t.columns, score_col)


def assign_score(template: DataFrame, scores: DataFrame, key: str = "id", score_col: str = "toxic") -> DataFrame:
    """Overwrite the template's own score column by key, its columns and their order kept.

    A template without that column is refused, as is a row without a score;
    scores for keys that the template lacks are left out.
    """
    if score_col not in template.columns:
        raise ValueError(f"the template has no column {score_col!r}")
    return _with_scores(template.drop(score_col), scores, key, score_col).select(*template.columns)


def _with_scores(t: DataFrame, scores: DataFrame, key: str, score_col: str) -> DataFrame:
    j = t.join(scores.select(key, score_col), key, "left")
    checked = F.when(F.col(score_col).isNull(),
                     F.raise_error(F.concat(F.lit("no score for id "), F.col(key).cast("string")))
                     .cast("double")).otherwise(F.col(score_col))
    return j.withColumn(score_col, checked)


# --- model fitting (Q5-Q7) ------------------------------------------------------

def prepare_training(df: DataFrame, weight_mode: str = "constant") -> DataFrame:
    """L1 labels + L6 weights + P3 text fill, as the classifier expects."""
    d = df.withColumn("comment_text", F.coalesce("comment_text", F.lit("none")))
    d = loss_weight(d, mode=weight_mode)
    return d.withColumn("label", binarise("toxic").cast("double"))


def epoch_rows(train_by_epoch: DataFrame, texts: DataFrame, dim: int) -> DataFrame:
    """The solver's rows of all epochs' draws, stored: each text of ``texts`` (id, comment_text) is hashed once."""
    draws = prepare_training(train_by_epoch).select(F.col("epoch").alias("model"), "id", F.col("label").alias("y"), F.col("weight").alias("w"))
    filled = texts.select("id", F.coalesce("comment_text", F.lit("none")).alias("comment_text"))
    return materialize(solver.training_rows(draws, filled, "id", "comment_text", dim))


def fit_epochs(train_by_epoch: DataFrame, texts: DataFrame, epochs: int, steps: int = 12, dim: int = 1 << 16,
               loss: str | solver.Loss = "weighted_bce", lr: float = 0.3) -> solver.State:
    """Q5: one model per epoch draw, fitted to ``loss`` (the loss called so, or a ``Loss`` of one's own); all models learn in the same jobs."""
    rows = epoch_rows(train_by_epoch, texts, dim)
    return solver.fit(rows, solver.State.new(range(1, epochs + 1), dim), steps, loss, lr)


def score_epochs(state: solver.State, valid: DataFrame) -> DataFrame:
    """Every epoch's model on the validation rows: ``(epoch, id, y, prob, logit)``."""
    rows = valid.withColumn("y", binarise("toxic"))
    return solver.score(rows, state, ["id", "y"], "comment_text").select(F.col("model").alias("epoch"), "id", "y", "prob", "logit")


def tune(rows: DataFrame, state: solver.State, rounds: int, steps: int, spark: SparkSession, path: str,
         loss: str | solver.Loss = "weighted_bce", lr: float = 0.3) -> Iterator[tuple[int, solver.State]]:
    """Q7: goes on from ``state`` on other rows, round r with ``lr / r``; each round starts from what the one before saved below ``path``."""
    solver.save_state(spark, state, f"{path}/round=0")
    for r in range(1, rounds + 1):
        now = solver.fit(rows, solver.load_state(spark, f"{path}/round={r - 1}"), steps, loss, lr / r)
        solver.save_state(spark, now, f"{path}/round={r}")
        yield r, now


def evaluate_epochs(scored: DataFrame, loss: str = "weighted_bce") -> DataFrame:
    """Q6: per epoch validation loss (by name) and AUC (A5), with the counts of both classes."""
    losses = loss_by_name(loss, scored.withColumn("w", F.lit(1.0)), "logit", "y", "w", ["epoch"])
    return losses.join(roc_auc(scored, "y", "prob", ["epoch"]), "epoch")
