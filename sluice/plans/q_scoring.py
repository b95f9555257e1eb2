"""Queries for scoring: Q1-Q7, J1, J2, A4, P8, P9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sluice.functions import scoring as SC
from sluice.functions.text import clean_text
from sluice.operators import sampling as M
from sluice.operators import scoring as R
from sluice.operators import solver as SV
from sluice.plans import solver_sql as FS
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.session import scratch_path
from sluice.sources import tables as T

W0 = SC.head_weights(64, 7, 3)
W1 = SC.head_weights(64, 5, 2)
B0 = 0.1
TW, TB = SC.TEXT_HEAD_WEIGHTS, SC.TEXT_HEAD_BIAS
VIEWS = ("orig", "lower", "clean")


def _dot_sql(vec: str, mod: int, shift: int) -> str:
    return (f"list_sum(list_transform({vec}, lambda lam_v, lam_i: CAST(lam_v AS DOUBLE) * "
            f"(((lam_i - 1) % {mod}) - {shift}) / 10.0))")


def _text_logit_sql(t: str) -> str:
    n = f"CAST(length({t}) AS DOUBLE)"
    excl = f"({n} - length(replace({t}, '!', '')))"
    upper = f"({n} - length(regexp_replace({t}, '\\p{{Lu}}', '', 'g')))"
    ntok = f"CAST(len({S.tokens(t)}) AS DOUBLE)"
    return (f"({TW[0]} * ln(1 + {n}) + {TW[1]} * ln(1 + {ntok}) + {TW[2]} * {excl} / ({n} + 1) "
            f"+ {TW[3]} * {upper} / ({n} + 1) + {TB})")


def _emb(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings")


@register("linear_head", sql=f"SELECT vec_id, round({_dot_sql('embedding', 7, 3)} + {B0}, 9) AS logit FROM embeddings")
def linear_head(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return e.select("vec_id", F.round(SC.linear_head("embedding", W0, B0), 9).alias("logit"))


@register("softmax_pos", sql=f"""
SELECT vec_id, round(1 / (1 + exp(({_dot_sql('embedding', 7, 3)} + {B0}) - ({_dot_sql('embedding', 5, 2)} + {B0}))), 9) AS prob
FROM embeddings
""")
def softmax_pos(spark, sf_dir):
    e = _emb(spark, sf_dir)
    x0 = SC.linear_head("embedding", W0, B0)
    x1 = SC.linear_head("embedding", W1, B0)
    return e.select("vec_id", F.round(SC.softmax_pos(x0, x1), 9).alias("prob"))


def _test_features(spark, sf_dir, view: str = "orig"):
    t = T.test_table(spark, sf_dir)
    text = {"orig": F.col("content"), "lower": F.lower("content"), "clean": clean_text("content")}[view]
    return t.select("id", SC.text_features(text).alias("features"))


@register("batch_score", sql=f"SELECT doc_id AS id, round({_text_logit_sql('text')}, 9) AS logit FROM documents")
def batch_score(spark, sf_dir):
    s = R.batch_score(_test_features(spark, sf_dir), "id", "features", TW, TB)
    return s.select("id", F.round("logit", 9).alias("logit"))


@register("flatten_scores", sql=f"SELECT doc_id AS id, round({_text_logit_sql('text')}, 9) AS logit FROM documents")
def flatten_scores(spark, sf_dir):
    arr = R.score_arrays(_test_features(spark, sf_dir), "id", "features", TW, TB)
    return R.flatten_scores(arr, "id", "logits").select("id", F.round("logit", 9).alias("logit"))


def _long_scores(spark, sf_dir):
    t = T.test_table(spark, sf_dir)
    views = {"orig": F.col("content"), "lower": F.lower("content"), "clean": clean_text("content")}
    long_ = R.views_from_columns(t, "id", views, "text")
    feats = long_.select("id", "view", SC.text_features("text").alias("features"))
    return R.score_views(feats, "id", "features", TW, TB)


VIEW_SQL = f"""views AS (
  SELECT doc_id AS id, 'orig' AS view, {_text_logit_sql('text')} AS logit FROM documents
  UNION ALL SELECT doc_id, 'lower', {_text_logit_sql('lower(text)')} FROM documents
  UNION ALL SELECT doc_id, 'clean', {_text_logit_sql(S.clean_text('text'))} FROM documents)"""


@register("multi_view_score", sql=f"WITH {VIEW_SQL} SELECT id, view, round(logit, 9) AS logit FROM views")
def multi_view_score(spark, sf_dir):
    return _long_scores(spark, sf_dir).select("id", "view", F.round("logit", 9).alias("logit"))


@register("ensemble_join", sql=f"""
WITH {VIEW_SQL}
SELECT a.id, round(a.logit, 9) AS p_orig, round(b.logit, 9) AS p_lower, round(c.logit, 9) AS p_clean
FROM views a JOIN views b ON a.id = b.id AND b.view = 'lower' JOIN views c ON a.id = c.id AND c.view = 'clean'
WHERE a.view = 'orig'
""")
def ensemble_join(spark, sf_dir):
    j = R.ensemble_join(_long_scores(spark, sf_dir), "id", VIEWS)
    return j.select("id", *[F.round(f"p_{v}", 9).alias(f"p_{v}") for v in VIEWS])


@register("ensemble_mean", sql=f"""
WITH {VIEW_SQL} SELECT id, round(avg(logit), 9) AS toxic FROM views WHERE view IN ('orig', 'lower') GROUP BY id
""")
def ensemble_mean(spark, sf_dir):
    two = _long_scores(spark, sf_dir).filter(F.col("view").isin("orig", "lower"))
    return R.ensemble_mean(two, "id").select("id", F.round("toxic", 9).alias("toxic"))


SUBMISSION_SQL = f"""
WITH {VIEW_SQL}, s AS (SELECT id, avg(logit) AS toxic FROM views GROUP BY id)
SELECT d.doc_id AS id, d.lang, round(s.toxic, 9) AS toxic FROM documents d LEFT JOIN s ON d.doc_id = s.id
"""


def _template(spark, sf_dir):
    # the submission template: every test id, a placeholder score column
    t = T.test_table(spark, sf_dir)
    return t.select("id", "lang", F.lit(0.0).alias("toxic"))


@register("submission_join", sql=SUBMISSION_SQL)
def submission_join(spark, sf_dir):
    scores = R.ensemble_mean(_long_scores(spark, sf_dir), "id")
    out = R.submission_join(_template(spark, sf_dir), scores, "id", "toxic")
    return out.select("id", "lang", F.round("toxic", 9).alias("toxic"))


@register("assign_score", sql=f"""
WITH {VIEW_SQL}, s AS (SELECT id, avg(logit) AS toxic FROM views WHERE view <> 'clean' GROUP BY id)
SELECT d.doc_id AS id, round(s.toxic, 9) AS toxic, d.lang FROM documents d JOIN s ON d.doc_id = s.id WHERE d.lang <> 'fr'
""")
def assign_score(spark, sf_dir):
    # The template's own `toxic` column is replaced where it stands; it holds fewer rows than were scored
    scores = R.ensemble_mean(_long_scores(spark, sf_dir).filter(F.col("view") != "clean"), "id")
    template = _template(spark, sf_dir).select("id", "toxic", "lang").filter(F.col("lang") != "fr")
    return R.assign_score(template, scores).withColumn("toxic", F.round("toxic", 9))


# three models of the same features: the fixed head, a flatter one and one that only counts marks
MODELS = {"base": (TW, TB), "flat": (tuple(x / 2 for x in TW), 0.25), "marks": ((0.0, 0.0, 30.0, 4.0), -1.0)}


def _text_logit_of(t: str, weights, bias: float) -> str:
    n = f"CAST(length({t}) AS DOUBLE)"
    feats = (f"ln(1 + {n})", f"ln(1 + CAST(len({S.tokens(t)}) AS DOUBLE))", f"({n} - length(replace({t}, '!', ''))) / ({n} + 1)",
             f"({n} - length(regexp_replace({t}, '\\p{{Lu}}', '', 'g'))) / ({n} + 1)")
    return "(" + " + ".join(f"{w!r} * {f}" for w, f in zip(weights, feats)) + f" + {bias!r})"


def file_scores(rows):
    """Q3 on the test rows of some files: ``(id, toxic)``."""
    return R.batch_score(rows.select("id", SC.text_features("content").alias("features")), "id", "features", TW, TB, "toxic")


def model_scores(spark, sf_dir):
    """Three models over two views, the views' mean per model and id: ``(model, id, toxic)``."""
    views = {"orig": F.col("content"), "lower": F.lower("content")}
    long_ = R.views_from_columns(T.test_table(spark, sf_dir), "id", views, "text")
    feats = long_.select("id", "view", SC.text_features("text").alias("features"))
    return R.ensemble_mean(R.score_models(feats, "id", "features", MODELS), ["model", "id"])


MODEL_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS model, doc_id AS id, round(({_text_logit_of('text', w, b)} + {_text_logit_of('lower(text)', w, b)}) / 2, 9) AS toxic FROM documents"
    for name, (w, b) in MODELS.items())


# --- fitting -----------------------------------------------------------------------
# The SQL repeats every step of the solver, see solver_sql.

EPOCHS = 3
N_NEG = 100
DIM = 1 << 16
STEPS = 12
LR = 0.3
TUNE_ROUNDS, TUNE_STEPS = 2, 4
DIGITS = 5


def train_by_epoch(spark, sf_dir, n_negatives: int = N_NEG, epochs: int = EPOCHS, mode: str = "floor"):
    """M4 for every epoch, without the validation rows."""
    return M.epoch_trainsets(T.set1(spark, sf_dir), T.soft_set2(spark, sf_dir), n_negatives, epochs, mode,
                             exclude=T.valid(spark, sf_dir))


def _texts(spark, sf_dir):
    return T.comments(spark, sf_dir).select("id", "comment_text")


def scored_epochs(spark, sf_dir, loss="weighted_bce"):
    """(training rows by epoch, the fitted state, validation rows scored by each epoch's model)."""
    tr = train_by_epoch(spark, sf_dir)
    state = R.fit_epochs(tr, _texts(spark, sf_dir), EPOCHS, STEPS, DIM, loss, LR)
    return tr, state, R.score_epochs(state, T.valid(spark, sf_dir))


def _losses_of(spark, state, name: str = "weighted_bce"):
    """Each model's loss before every step and its weights' sums after the last: ``(criterion, epoch, measure, step, value)``."""
    rows = []
    for i, m in enumerate(state.models):
        rows += [(name, m, "loss", k + 1, losses[i]) for k, losses in enumerate(state.losses)]
        rows += [(name, m, "weight_sum", state.step, float(state.w[i].sum())), (name, m, "weight_norm", state.step, float((state.w[i] ** 2).sum()))]
    df = spark.createDataFrame(rows, "criterion string, epoch int, measure string, step int, value double")
    return df.withColumn("value", F.round("value", DIGITS))


_S2 = f"(SELECT id, CASE WHEN toxic >= 0.95 THEN toxic ELSE 0.0 END AS toxic FROM {S.soft_set2()} q WHERE id % 5 <> 0)"
_NEGS = f"""(SELECT epoch, id, toxic FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {S.sql_u32('id', 'negatives', 42, 'epoch')}, id) AS rn
  FROM {_S2} n, range(1, {EPOCHS + 1}) e(epoch) WHERE toxic = 0) x WHERE rn <= {N_NEG})"""
TRAIN_SQL = f"""train AS (
  SELECT epoch, id, toxic FROM (SELECT id, toxic FROM {S.SET1} a WHERE id % 5 <> 0
                                UNION ALL SELECT id, toxic FROM {_S2} b WHERE toxic >= 0.95) f, range(1, {EPOCHS + 1}) e(epoch)
  UNION ALL SELECT epoch, id, toxic FROM {_NEGS} c)"""
_MEMBERS = """SELECT CAST(epoch AS INTEGER) AS model, id, CASE WHEN toxic >= 0.95 THEN 1.0 ELSE 0.0 END AS y,
                     CASE WHEN toxic = 0 THEN 0.9 ELSE toxic END AS w FROM """
_FEATURES = FS.features(S.COMMENTS, "id", "comment_text", DIM)


@register("fit_classifier", sql=f"""
WITH RECURSIVE {TRAIN_SQL},
{_FEATURES},
{FS.fit([(_MEMBERS + 'train', STEPS, LR)], 'weighted_bce')}
{FS.history(STEPS, DIGITS)}
""")
def fit_classifier(spark, sf_dir):
    """Q5: a model per epoch draw; its loss before each step and its weights after the last."""
    return _losses_of(spark, scored_epochs(spark, sf_dir)[1])


CRITERIA = ("weighted_bce", "focal", "label_smoothing")


@register("fit_criterion", sql="\nUNION ALL\n".join(f"""(
WITH RECURSIVE {TRAIN_SQL},
{_FEATURES},
{FS.fit([(_MEMBERS + 'train WHERE epoch = 1', STEPS, LR)], loss)}
{FS.history(STEPS, DIGITS, loss)})""" for loss in CRITERIA))
def fit_criterion(spark, sf_dir):
    """Q5 with A6, A7 and A8 as the criterion: the same rows and steps, another loss."""
    rows = R.epoch_rows(train_by_epoch(spark, sf_dir, epochs=1), _texts(spark, sf_dir), DIM)
    out = [_losses_of(spark, SV.fit(rows, SV.State.new([1], DIM), STEPS, loss, LR), loss) for loss in CRITERIA]
    return out[0].unionByName(out[1]).unionByName(out[2])


_VALID = f"(SELECT id, 1 AS epoch, toxic FROM {S.VALID} q)"


@register("evaluate_epochs", sql=f"""
WITH RECURSIVE {TRAIN_SQL},
{_FEATURES},
{FS.fit([(_MEMBERS + 'train', STEPS, LR)], 'weighted_bce')},
valid AS (SELECT id, CASE WHEN toxic >= 0.95 THEN 1 ELSE 0 END AS y FROM {S.VALID} q),
scored AS MATERIALIZED (SELECT s.model, s.id, v.y, round(s.x, 9) AS x FROM ({FS.logits(f'step = {STEPS}', 'valid')}) s JOIN valid v ON s.id = v.id)
SELECT a.model AS epoch, count(*) FILTER (WHERE a.y = 1)::BIGINT AS n_pos, count(*) FILTER (WHERE a.y = 0)::BIGINT AS n_neg,
       round(avg(greatest(a.x, 0) - a.x * a.y + ln(1 + exp(-abs(a.x)))), {DIGITS}) AS loss,
       round((SELECT avg(CASE WHEN p.x > n.x THEN 1.0 WHEN p.x = n.x THEN 0.5 ELSE 0.0 END) FROM scored p JOIN scored n
              ON p.model = n.model WHERE p.model = a.model AND p.y = 1 AND n.y = 0), {DIGITS}) AS auc
FROM scored a GROUP BY a.model
""")
def evaluate_epochs(spark, sf_dir):
    """Q6: every epoch's model on validation rows that no fit saw: loss and AUC."""
    scored = scored_epochs(spark, sf_dir)[2].withColumn("logit", F.round("logit", 9)).withColumn("prob", F.col("logit"))
    ev = R.evaluate_epochs(scored)
    return ev.select("epoch", "n_pos", "n_neg", F.round("loss", DIGITS).alias("loss"), F.round("auc", DIGITS).alias("auc"))


def tune_rounds(spark, sf_dir):
    """Q7: the first epoch's model goes on with the validation rows, round 2 from what round 1 saved and with half its
    step size; every document is scored after each round."""
    state = R.fit_epochs(train_by_epoch(spark, sf_dir, epochs=1), _texts(spark, sf_dir), 1, STEPS, DIM, "weighted_bce", LR)
    rows = R.epoch_rows(T.valid(spark, sf_dir).withColumn("epoch", F.lit(1)), _texts(spark, sf_dir), DIM)
    test = T.test_table(spark, sf_dir)
    rounds = R.tune(rows, state, TUNE_ROUNDS, TUNE_STEPS, spark, scratch_path(spark, "tuned"), "weighted_bce", LR)
    return reduce(lambda a, b: a.unionByName(b), [
        SV.score(test, now, ["id"], "content").select(F.lit(r).alias("round"), "id", F.col("prob").alias("toxic")) for r, now in rounds])


@register("tune_then_score", sql=f"""
WITH RECURSIVE {TRAIN_SQL},
{FS.features('documents', 'doc_id', 'text', DIM)},
{FS.fit([(_MEMBERS + 'train WHERE epoch = 1', STEPS, LR), *[(_MEMBERS + _VALID + ' v', TUNE_STEPS, LR / r) for r in range(1, TUNE_ROUNDS + 1)]], 'weighted_bce')}
SELECT ((step - {STEPS}) // {TUNE_STEPS})::INTEGER AS round, id, round(1 / (1 + exp(-x)), {DIGITS}) AS toxic
FROM ({FS.logits(f"step IN ({', '.join(str(STEPS + r * TUNE_STEPS) for r in range(1, TUNE_ROUNDS + 1))})")}) s
""")
def tune_then_score(spark, sf_dir):
    return tune_rounds(spark, sf_dir).select("round", "id", F.round("toxic", DIGITS).alias("toxic"))
