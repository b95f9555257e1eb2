"""Hand-worked golden cases (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import labels as L
from sluice.functions import sequences as Q
from sluice.functions import text as X
from sluice.functions.scoring import softmax_pos
from sluice.operators import metrics as A
from sluice.operators import sampling as M
from sluice.operators.labels import label_counts, loss_weight
from sluice.operators.scoring import ensemble_mean
from sluice.operators.sequences import length_buckets, trim_batch


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def apply(spark, fn, values, typ="string"):
    df = one_col(spark, values, typ)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("src,out", [
    ('Hi "Bob" 42 times!', "Hi Bob times!"),
    ("see #tag1! and @user!!", "see ! and !!"),
    ("go http://a.b/c?d=1 now", "go now"),
    ("mail x@y.com ok", "mail x ok"),
    ("# alone @ alone", "# alone @ alone"),
    ("café #été fin", "café fin"),
    ("A b. C d. A b.", "A b. C d."),
    ("one\ntwo three", "one two three"),
    ("", ""),
])
def test_clean_text(spark, src, out):
    assert apply(spark, X.clean_text, [src]) == [out]


def test_clean_text_renders_missing_as_nan(spark):
    assert apply(spark, X.clean_text, [None]) == ["nan"]


def test_strip_numbers_keeps_quotes(spark):
    assert apply(spark, X.strip_numbers, ['Hi "Bob" 42 times!']) == ['Hi "Bob" times!']


def test_squeeze_spaces_python_whitespace(spark):
    assert apply(spark, X.squeeze_spaces, ["a\x1cb\xa0\x85c"]) == ["a b c"]


def test_lang_name(spark):
    assert apply(spark, X.lang_name, ["fr", "de", None]) == ["french", "english", "english"]


def test_round_half_even(spark):
    assert apply(spark, L.round_half_even, [0.5, 1.5, 2.5], "double") == [0, 2, 2]


def test_binarise_and_floor(spark):
    vals = [0.94, 0.95, 0.97, None]
    assert apply(spark, L.binarise, vals, "double") == [0, 1, 1, 0]
    assert apply(spark, L.floor_below, vals, "double") == [0.0, 0.95, 0.97, 0.0]


def test_loss_weight_constant_and_ratio(spark):
    tr = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.97)], "id int, toxic double")
    out = loss_weight(tr, w=0.9).orderBy("id").select("weight").collect()
    assert [r[0] for r in out] == [0.9, 1.0, 0.97]
    # train ratio .10, valid ratio .20 -> zeros weigh .5
    train = spark.createDataFrame([(i, 1.0 if i < 1 else 0.0) for i in range(10)], "id int, toxic double")
    valid = spark.createDataFrame([(i, 1.0 if i < 2 else 0.0) for i in range(10)], "id int, toxic double")
    w = loss_weight(train, valid, mode="ratio").filter("toxic = 0").select("weight").distinct().collect()
    assert [round(r[0], 9) for r in w] == [0.5]


def test_label_counts(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (0.97,)], "toxic double")
    r = label_counts(df).collect()[0]
    assert (r.n0, r.n1) == (2, 1) and abs(r.pos_ratio - 1 / 3) < 1e-12


def test_sample_exact_n_errors_and_head(spark):
    df = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception):
        M.sample_exact_n(df, 2).collect()
    assert M.shuffle_head(df, 2).count() == 1


def test_shard_rows(spark):
    df = spark.range(10)
    out = M.shard_rows(df, 4).collect()
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.id)
    assert sorted(len(v) for v in per.values()) == [3, 3, 3, 3]
    counts = {}
    for r in out:
        counts[r.id] = counts.get(r.id, 0) + 1
    twice = sorted(k for k, v in counts.items() if v == 2)
    order = {r.id: r.idx for r in out if r.idx < 10}
    assert len(twice) == 2 and sorted(order[k] for k in twice) == [0, 1]


def arr(spark, values):
    return spark.createDataFrame([(values,)], "a array<int>")


def test_truncations(spark):
    a = arr(spark, list(range(1, 11)))
    assert a.select(Q.truncate_head_tail("a", 4)).first()[0] == [1, 2, 9, 10]
    assert a.select(Q.truncate_head_tail("a", 5)).first()[0] == [1, 2, 8, 9, 10]
    b = arr(spark, list(range(11, 17)))
    assert b.select(Q.truncate_inner("a", 6)).first()[0] == [2, 11, 12, 15, 16, 3]
    assert b.select(Q.truncate_inner("a", 7)).first()[0] == [2, 11, 12, 14, 15, 16, 3]
    c = arr(spark, [11])
    assert c.select(Q.pad_right(Q.truncate_inner("a", 6), 6)).first()[0] == [2, 11, 3, 0, 0, 0]
    d = arr(spark, [2, 11, 12, 13, 3])
    assert d.select(Q.truncate_right("a", 4)).first()[0] == [2, 11, 12, 3]


def test_mask_and_lengths(spark):
    a = arr(spark, [2, 11, 3, 0, 0, 0])
    r = a.select(Q.attention_mask("a").alias("m")).select("m", Q.token_length("m")).first()
    assert r[0] == [1, 1, 1, 0, 0, 0] and r[1] == 3
    assert a.select(Q.pad_count("a")).first()[0] == 3


def test_length_buckets_count(spark):
    rows = [(i, [5] * (1 + i % 150) + [0] * (191 - i % 150), (i * 2654435761) % (1 << 32)) for i in range(503)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, ord long")
    b = length_buckets(df, "ids", "ord", "id", 16).collect()
    assert len(b) == 503 and len({r.id for r in b}) == 503
    assert len({r.batch_id for r in b}) == 32
    bd = length_buckets(df, "ids", "ord", "id", 16, drop_last=True).collect()
    assert len({r.batch_id for r in bd}) == 31


def test_trim_batch(spark):
    df = spark.createDataFrame([(0, [2, 5, 3, 0, 0, 0, 0, 0]), (0, [2, 5, 6, 7, 3, 0, 0, 0]),
                                (1, [2, 3, 0, 0, 0, 0, 0, 0])], "batch long, ids array<int>")
    out = {tuple(r.ids) for r in trim_batch(df, "batch", ["ids"], "ids").collect()}
    assert (2, 5, 3, 0, 0) in out and (2, 5, 6, 7, 3) in out and (2, 3, 0, 0, 0, 0, 0, 0) in out


def test_minmax(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r[0] for r in A.minmax_scale(df, "x").collect()) == [0.0, 0.5, 1.0]
    df2 = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r[0] for r in A.minmax_scale(df2, "x").collect()] == [None, None]


@pytest.mark.parametrize("ys,ss", [([0, 0, 1, 1], [.1, .4, .35, .8]), ([0, 1, 1, 0], [.5, .5, .9, .5])])
def test_auc(spark, ys, ss):
    df = spark.createDataFrame(list(zip(ys, ss)), "y int, score double")
    assert abs(A.roc_auc(df).first().auc - 0.75) < 1e-12


def test_running_auc_with_seeds(spark):
    df = spark.createDataFrame([(0, 1, .9), (0, 0, .2), (1, 0, .95)], "step long, y int, score double")
    out = sorted((r.step, round(r.auc, 6)) for r in A.running_auc(df).collect())
    assert out == [(0, 0.875), (1, 0.583333)]


def test_running_loss(spark):
    df = spark.createDataFrame([(0, 1.0, 2), (1, 4.0, 1)], "step long, loss double, n int")
    out = sorted((r.step, r.avg_loss) for r in A.running_loss(df, "loss", "n").collect())
    assert out == [(0, 1.0), (1, 2.0)]


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0), (-1.0, 0.0, 0.9), (0.5, 0.0, 0.9)], "x double, y double, w double")
    assert round(A.weighted_bce(df, "x", "y", "w").first().loss, 6) == 0.428511
    assert round(A.focal_loss(df, "x", "y").first().loss, 6) == 0.054321
    lg = spark.createDataFrame([([0.0, 2.0], 1)], "logits array<double>, t int")
    r = A.label_smoothing_loss(lg, "logits", "t").first()
    assert round(r.smoothed, 6) == 0.226928 and round(r.plain, 6) == 0.126928


def test_softmax_pos(spark):
    assert round(spark.range(1).select(softmax_pos(F.lit(0.0), F.lit(2.0))).first()[0], 6) == 0.880797


def test_best_epoch(spark):
    df = spark.createDataFrame([(1, .7), (2, .8), (3, .8)], "epoch int, auc double")
    assert A.best_epoch(df).first().best_epoch == 2
    z = spark.createDataFrame([(1, 0.0), (2, 0.0)], "epoch int, auc double")
    assert A.best_epoch(z).first().best_epoch == 1


def test_ensemble_mean(spark):
    df = spark.createDataFrame([(1, "a", .2), (1, "b", .6)], "id int, view string, logit double")
    assert round(ensemble_mean(df, "id").first().toxic, 12) == 0.4


def test_one_hot(spark):
    assert spark.range(1).select(L.one_hot(F.lit(1), 2)).first()[0] == [0.0, 1.0]


@pytest.mark.parametrize("lang,text,out", [
    ("en", "Mr. X met Dr. Y. They left!  Then? ok", ["Mr. X met Dr. Y.", "They left!", "Then?", "ok"]),
    (None, "Mr. X. Go.", ["Mr. X.", "Go."]), ("de", "Mr. X. Go.", ["Mr. X.", "Go."]),
    ("fr", "M. X est Mr. Y. Fin.", ["M. X est Mr.", "Y.", "Fin."]), ("es", "La Sra. X y Ud. van. Fin.", ["La Sra. X y Ud. van.", "Fin."]),
    ("ru", "Живёт в Г. Москва. Да.", ["Живёт в Г. Москва.", "Да."]), ("tr", "Örn. bu. Evet.", ["Örn. bu.", "Evet."]),
    ("en", "Hammr. X e.g. this\nis. It", ["Hammr.", "X e.g. this\nis.", "It"]), ("en", "", [""]),
])
def test_split_sentences_by_language(spark, lang, text, out):
    df = spark.createDataFrame([(text, lang)], "t string, lang string")
    assert df.select(X.split_sentences("t", "lang")).first()[0] == out


def test_pool_mean_max_vector(spark):
    df = spark.createDataFrame([(1, [1.0, -5.0]), (1, [3.0, -1.0]), (2, [0.0, 2.0]), (2, None)], "k int, v array<float>")
    assert {r.k: r.pooled for r in A.pool_mean_max(df, "k", "v").collect()} == {1: [2.0, -3.0, 3.0, -1.0], 2: [0.0, 2.0, 0.0, 2.0]}
