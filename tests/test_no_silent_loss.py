"""Rows that used to vanish, or to be ranked without a rank: each is kept or refused."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import augment as G
from sluice.operators import metrics as A
from sluice.operators import ranking as R
from sluice.operators import sampling as M
from sluice.operators.scoring import assign_score
from sluice.operators.sequences import build_vocab, encode, encode_tokens


def test_null_groups_are_groups(spark):
    rows = [("a", 0, 1, 0.9, 1.0), ("a", 1, 0, 0.1, 2.0), (None, 0, 1, 0.2, 3.0), (None, 1, 0, 0.4, 5.0), ("a", 2, 1, 0.3, 3.0), (None, 2, 1, 0.6, 1.0)]
    df = spark.createDataFrame(rows, "g string, step long, y int, score double, loss double").withColumn("n", F.lit(1))
    auc = {r.g: (r.n_pos, r.n_neg, r.auc) for r in A.roc_auc(df, "y", "score", ["g"]).collect()}
    assert auc == {"a": (2, 1, 1.0), None: (2, 1, 0.5)}
    loss = {(r.g, r.step): r.avg_loss for r in A.running_loss(df, "loss", "n", "step", ["g"]).collect()}
    assert loss == {("a", 0): 1.0, ("a", 1): 1.5, ("a", 2): 2.0, (None, 0): 3.0, (None, 1): 4.0, (None, 2): 3.0}
    assert A.running_auc(df, group_cols=["g"]).count() == 6
    ranked = df.withColumn("h", (F.col("score") * 1e9).cast("long"))
    assert sorted((str(r.g), r.idx) for r in R.dense_index(ranked, "h", "step", ["g"]).collect()) == [
        ("None", 0), ("None", 1), ("None", 2), ("a", 0), ("a", 1), ("a", 2)]
    for bound in (None, 2):
        assert R.smallest_n(ranked, 2, "h", "step", ["g"], strict=True, groups_bound=bound).groupBy("g").count().collect().__len__() == 2


@pytest.mark.parametrize("score", [None, float("nan")])
def test_missing_scores_are_refused(spark, score):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 0, score)], "step long, y int, score double")
    for fn in (A.roc_auc, A.running_auc):
        with pytest.raises(Exception, match="missing or not a number"):
            fn(df).collect()


def test_missing_class_is_refused(spark):
    df = spark.createDataFrame([(1, 0.5), (None, 0.2)], "y int, score double")
    with pytest.raises(Exception, match="missing"):
        A.roc_auc(df).collect()


def test_draws_from_an_empty_class_fail(spark):
    pool = spark.createDataFrame([(0, 0, "p0")], "cls int, idx long, text string")
    rows = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, toxic double")
    with pytest.raises(Exception, match="no text of class 1"):
        G.draw_slots(rows, "id", "toxic", pool).collect()
    assert G.draw_slots(rows.withColumn("toxic", F.lit(0.0)), "id", "toxic", pool).count() >= 5


@pytest.mark.parametrize("n,shards", [(2, 7), (1, 4), (10, 4), (7, 7), (0, 3)])
def test_shards_are_equal_however_few_the_rows(spark, n, shards):
    sizes = {r.shard: r["count"] for r in M.shard_rows(spark.range(n), shards).groupBy("shard").count().collect()}
    assert sizes == ({s: -(-n // shards) for s in range(shards)} if n else {})


def test_negatives_are_all_rows_below_the_threshold(spark):
    s1 = spark.createDataFrame([(10, "x", 1.0)], "id long, comment_text string, toxic double")
    s2 = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.3), (3, "c", 0.96)], "id long, comment_text string, toxic double")
    for mode, pos in (("binarise", 1.0), ("floor", 0.96)):
        got = {(r.id, r.part, r.toxic) for r in M.compose_trainset(s1, s2, 2, mode).collect()}
        assert got == {(10, "set1", 1.0), (3, "set2_pos", pos), (1, "set2_neg", 0.0), (2, "set2_neg", 0.0)}
        drawn = M.epoch_trainsets(s1, s2, 1, 6, mode).filter("part = 'set2_neg'").collect()
        assert {r.epoch for r in drawn} == set(range(1, 7)) and {r.id for r in drawn} == {1, 2}
        with pytest.raises(Exception):
            M.compose_trainset(s1, s2, 3, mode).collect()
    kept = M.epoch_trainsets(s1, s2, 1, 1, exclude=spark.createDataFrame([(1,), (10,)], "id long"))
    assert {r.id for r in kept.collect()} == {2, 3}


def test_null_text_is_encoded_as_the_text_nan(spark):
    df = spark.createDataFrame([(1, None), (2, "nan"), (3, "")], "id long, t string")
    vocab = build_vocab(spark.createDataFrame([("nan",)], "t string"), "t", 5)
    assert {r.id: r.tokens for r in encode_tokens(df, "id", "t", vocab).collect()} == {1: [4], 2: [4], 3: []}
    assert {r.id: r.ids for r in encode(df, "id", "t", vocab, 4).collect()} == {1: [2, 4, 3, 0], 2: [2, 4, 3, 0], 3: [2, 3, 0, 0]}


@pytest.mark.parametrize("mode", ["head_tail", "inner", "right"])
@pytest.mark.parametrize("length", [7, 8])
def test_cut_before_lookup_changes_nothing(spark, mode, length):
    df = spark.createDataFrame([(n, " ".join(f"t{j}" for j in range(n))) for n in range(14)], "id long, t string")
    vocab = spark.createDataFrame([(f"t{j}", 100 + j) for j in range(14)], "token string, token_id int")
    got = {r.id: [x for x in r.ids if x] for r in encode(df, "id", "t", vocab, length, mode).collect()}
    for n, ids in got.items():
        marked = [2, *range(100, 100 + n), 3]
        if len(marked) > length:
            h = length // 2
            m = length - 2
            marked = {"head_tail": marked[:h] + marked[-(length - h):], "right": marked[:length - 1] + [3],
                      "inner": [2, *marked[1:-1][:m // 2], *marked[1:-1][-(m - m // 2):], 3]}[mode]
        assert ids == marked


def test_assign_score_replaces_the_column_in_place(spark):
    template = spark.createDataFrame([(1, 0.5, "a"), (2, 0.5, "b")], "id long, toxic double, lang string")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, toxic double")
    out = assign_score(template, scores)
    assert out.columns == template.columns and sorted(map(tuple, out.collect())) == [(1, 0.1, "a"), (2, 0.2, "b")]
    with pytest.raises(ValueError):
        assign_score(template.drop("toxic"), scores)
    with pytest.raises(Exception, match="no score for id 2"):
        assign_score(template, scores.filter("id <> 2")).collect()


def test_probabilities_focal_loss(spark):
    df = spark.createDataFrame([(0.8, 1.0), (0.3, 0.0), (1.0, 1.0)], "p double, y double")
    x = df.filter("p < 1").withColumn("x", F.log(F.col("p") / (1 - F.col("p"))))
    assert abs(A.focal_loss(df.filter("p < 1"), "p", "y", logits=False).first().loss - A.focal_loss(x, "x", "y").first().loss) < 1e-12
    assert A.focal_loss(df, "p", "y", logits=False).first().loss >= 0


def test_own_transform_steps(spark):
    df = spark.createDataFrame([(1, "Ab @c")], "id long, t string")
    out = G.train_transforms(df, "t", "id", "o", p=1.0, steps=[("low", F.lower), ("mark", lambda c: F.concat(c, F.lit("!")))])
    assert out.first().o == "ab @c!"


def test_losses_by_name(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0), (-1.0, 0.0, 0.9)], "x double, y double, w double")
    assert A.loss_by_name("weighted_bce", df, "x", "y", "w").first() == A.weighted_bce(df, "x", "y", "w").first()
    assert A.loss_by_name("focal", df, "x", "y", "w").first() == A.focal_loss(df, "x", "y").first()
    assert A.loss_by_name("bce", df, "x", "y", "w").first() != A.weighted_bce(df, "x", "y", "w").first()
    with pytest.raises(ValueError):
        A.loss_by_name("hinge", df, "x", "y", "w")
