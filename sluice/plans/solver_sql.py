"""SQL text of the gradient solver: the oracle repeats the fit step by step, in long form (one row per model and place)."""

from __future__ import annotations

from sluice.operators.metrics import FOCAL_ALPHA, FOCAL_GAMMA, SMOOTHING
from sluice.operators.solver import BETA1, BETA2, EPS
from sluice.plans import sqltext as S

_SIGMOID = "1 / (1 + exp(-x))"
_BCE = "greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))"
_HALF = "greatest(x, 0) - x * 0.5 + ln(1 + exp(-abs(x)))"
_IDENTITY = ("mean", "1.0")
_PT = "exp(-mean)"

#: (value of a row, its derivative, (loss of the mean, its derivative)) by name.
LOSSES = {
    "weighted_bce": (f"w * ({_BCE})", f"w * ({_SIGMOID} - y)", _IDENTITY),
    "focal": (_BCE, f"{_SIGMOID} - y",
              (f"{FOCAL_ALPHA} * pow(1 - {_PT}, {FOCAL_GAMMA}) * mean",
               f"{FOCAL_ALPHA} * (pow(1 - {_PT}, {FOCAL_GAMMA}) + {FOCAL_GAMMA} * pow(1 - {_PT}, {FOCAL_GAMMA - 1}) * {_PT} * mean)")),
    "label_smoothing": (f"{1 - SMOOTHING} * ({_BCE}) + {SMOOTHING} * ({_HALF})",
                        f"{1 - SMOOTHING} * ({_SIGMOID} - y) + {SMOOTHING} * ({_SIGMOID} - 0.5)", _IDENTITY),
}


def features(source: str, key: str, text: str, dim: int) -> str:
    """``ids(id)`` and ``feat(id, j, v)``: a text's tokens by place, each 1 / sqrt(number of tokens)."""
    tokens = S.tokens(f"coalesce({text}, 'none')")
    return f"""ids AS (SELECT {key} AS id FROM {source} s),
feat AS MATERIALIZED (
  SELECT id, j, count(*) / sqrt(max(n)) AS v
  FROM (SELECT id, n, {S.sql_u32('token', 'feature')} % {dim} AS j
        FROM (SELECT id, len(tk) AS n, unnest(tk) AS token FROM (SELECT {key} AS id, {tokens} AS tk FROM {source} s) a) b) c GROUP BY id, j)"""


def fit(phases: list[tuple[str, int, str | float]], loss: str) -> str:
    """CTEs ``mem``, ``sched`` and ``p(step, model, j, w, m, v)`` (place -1 is the intercept).

    ``phases`` has (members (model, id, y, w), steps, step size) of each phase; the WITH must be RECURSIVE.
    """
    value, slope, (_, outer_slope) = LOSSES[loss]
    members = " UNION ALL ".join(f"SELECT {i} AS phase, * FROM ({m}) m{i}" for i, (m, _, _) in enumerate(phases))
    steps = " UNION ALL ".join(f"SELECT unnest(range({sum(x[1] for x in phases[:i]) + 1}, {sum(x[1] for x in phases[:i + 1]) + 1})) AS k, {i} AS phase, {lr!r}::DOUBLE AS lr"
                               for i, (_, _, lr) in enumerate(phases))
    return f"""mem AS MATERIALIZED ({members}),
sched AS MATERIALIZED ({steps}),
p AS (
  SELECT 0::BIGINT AS step, model, j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
  FROM (SELECT DISTINCT model FROM mem) a, (SELECT DISTINCT j FROM feat UNION ALL SELECT -1) b
  UNION ALL
  SELECT step + 1, model, j, w - lr * (m / (1 - pow({BETA1}, step + 1)) / (sqrt(v / (1 - pow({BETA2}, step + 1))) + {EPS}) + 0.001 * w * (j >= 0)::INTEGER), m, v
  FROM (
    SELECT p.step, p.model, p.j, p.w, c.lr, {BETA1} * p.m + (1 - {BETA1}) * coalesce(g.g, 0) AS m, {BETA2} * p.v + (1 - {BETA2}) * coalesce(g.g, 0) * coalesce(g.g, 0) AS v
    FROM p JOIN sched c ON c.k = p.step + 1
    LEFT JOIN (
      SELECT e.model, f.j, sum(e.e * f.v) / max(e.n) * max(e.o) AS g
      FROM (SELECT model, id, e, count(*) OVER (PARTITION BY model) AS n, {outer_slope.replace('mean', 'avg(value) OVER (PARTITION BY model)')} AS o
            FROM (SELECT model, id, {value} AS value, {slope} AS e
                  FROM (SELECT m.model, m.id, m.y, m.w, b.w + coalesce(s.x, 0) AS x
                        FROM p b JOIN sched c ON c.k = b.step + 1 JOIN mem m ON m.model = b.model AND m.phase = c.phase
                        LEFT JOIN (SELECT p.model, f.id, sum(f.v * p.w) AS x FROM p JOIN feat f ON p.j = f.j GROUP BY ALL) s ON s.model = m.model AND s.id = m.id
                        WHERE b.j = -1) t) u) e
      JOIN (SELECT id, j, v FROM feat UNION ALL SELECT DISTINCT id, -1, 1.0 FROM mem) f ON e.id = f.id GROUP BY ALL) g
    ON g.model = p.model AND g.j = p.j) t)"""


def logits(where: str = "true", ids: str = "ids") -> str:
    """``(step, model, id, x)``: every model's logit for every row of ``ids`` after the steps that ``where`` names."""
    return f"""SELECT b.step, b.model, i.id, b.w + coalesce(s.x, 0) AS x FROM {ids} i JOIN p b ON b.j = -1 AND (b.{where})
  LEFT JOIN (SELECT p.step, p.model, f.id, sum(f.v * p.w) AS x FROM p JOIN feat f ON p.j = f.j WHERE p.{where} GROUP BY ALL) s
  ON s.step = b.step AND s.model = b.model AND s.id = i.id"""


def history(steps: int, digits: int, name: str = "weighted_bce") -> str:
    """Each model's loss before every step and its weights' sums after the last, in long form."""
    value, _, (outer, _) = LOSSES[name]
    return f"""SELECT '{name}' AS criterion, model AS epoch, measure, step::INTEGER AS step, round(value, {digits}) AS value FROM (
  SELECT model, 'loss' AS measure, step + 1 AS step, {outer} AS value FROM (
    SELECT l.step, l.model, avg({value}) AS mean FROM ({logits(f'step < {steps}')}) l JOIN (SELECT model, id, y, w FROM mem) m ON m.model = l.model AND m.id = l.id GROUP BY ALL) t
  UNION ALL SELECT model, 'weight_sum', step, sum(w) FROM p WHERE step = {steps} GROUP BY ALL
  UNION ALL SELECT model, 'weight_norm', step, sum(w * w) FROM p WHERE step = {steps} GROUP BY ALL) h"""
