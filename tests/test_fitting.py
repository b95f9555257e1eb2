"""The fits: what they saw, and loss and AUC recomputed from the scored rows."""

import math

import pytest

from paths import SF01
from sluice.operators.scoring import evaluate_epochs
from sluice.plans import q_scoring as P
from sluice.sources import tables as T


@pytest.fixture(scope="module")
def fitted(spark):
    tr, _, scored = P.scored_epochs(spark, SF01)
    return tr, scored.cache()


def test_validation_rows_stay_out_of_the_draw(spark, fitted):
    assert fitted[0].join(T.valid(spark, SF01), "id").count() == 0


def test_loss_and_auc_recomputed(spark, fitted):
    rows = fitted[1].collect()
    got = {r.epoch: r for r in evaluate_epochs(fitted[1]).collect()}
    assert sorted(got) == [1, 2, 3]
    for e, g in got.items():
        own = [r for r in rows if r.epoch == e]
        pos, neg = [r.prob for r in own if r.y == 1], [r.prob for r in own if r.y == 0]
        pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
        bce = sum(max(r.logit, 0) - r.logit * r.y + math.log1p(math.exp(-abs(r.logit))) for r in own) / len(own)
        assert (g.n_pos, g.n_neg) == (len(pos), len(neg))
        assert g.auc == pytest.approx(pairs / (len(pos) * len(neg))) and g.loss == pytest.approx(bce)
        assert all(math.isfinite(r.logit) for r in own)


def test_loss_is_chosen_by_name(fitted):
    a, b = ({r.epoch: r.loss for r in evaluate_epochs(fitted[1], loss).collect()} for loss in ("bce", "focal"))
    assert set(a) == set(b) and a != b


def test_rounds_go_on_from_what_was_saved(spark, tmp_path):
    from sluice.operators import scoring as R
    from sluice.operators import solver as S

    texts = P._texts(spark, SF01)
    state = R.fit_epochs(P.train_by_epoch(spark, SF01, epochs=1), texts, 1, 2, 1 << 12)
    rows = R.epoch_rows(T.valid(spark, SF01).selectExpr("*", "1 AS epoch"), texts, 1 << 12)
    done = dict(R.tune(rows, state, 2, 2, spark, str(tmp_path)))
    assert [done[r].step for r in (1, 2)] == [4, 6]
    by_hand = S.fit(rows, S.fit(rows, state, 2, lr=0.3), 2, lr=0.15)
    assert abs(by_hand.w - done[2].w).max() < 1e-9 and abs(S.load_state(spark, str(tmp_path / "round=1")).w - done[1].w).max() < 1e-15
