"""DuckDB SQL of the fixed models, written out for the oracles: no formula is taken from the engine.

Every constant stands here again, so that a wrong constant or formula on either
side shows as a difference.  The relations read have the columns of the feature contract.
"""

from __future__ import annotations

FEATURES = ["amount", "amount_ratio", "balance_diff_orig", "is_transfer", "is_cashout", "hour_of_day", "txn_velocity_1h"]

# Demo models: only the amount matters.  The net caps the scaled amount at 0.12 and gives the other six back.
DEMO_IF = "1 / (1 + exp((100 - CAST(amount AS DOUBLE)) / 100))"
DEMO_AE = "least(greatest(CAST(amount AS DOUBLE) / 1000 - 0.12, 0) ** 2 / 7 / 0.01, 1.0)"
DEMO_SGD = "0.1 + 0.8 * least(greatest(CAST(amount AS DOUBLE) / 1000, 0), 1.0)"
DEMO_ENSEMBLE = f"0.4 * ({DEMO_IF}) + 0.3 * ({DEMO_AE}) + 0.3 * ({DEMO_SGD})"

# Logistic model.
LOGIT = """1 / (1 + exp(4.0 - 0.008 * amount - 0.3 * amount_ratio + 0.002 * balance_diff_orig - 1.5 * is_transfer
  - 1.0 * is_cashout - 0.02 * hour_of_day - 0.4 * txn_velocity_1h))"""

AE_THRESHOLD = 0.05
AE_MINS = "[0, 0, -600, 0, 0, 0, 1]"
AE_MAXS = "[600, 600, 10, 1, 1, 23, 3]"
AE_WIDTHS = [7, 5, 3, 5, 7]


def topic(threshold: float) -> str:
    """A score that is no number is not an anomaly."""
    return f"CASE WHEN isnan(ensemble_score) THEN 'metrics' WHEN ensemble_score >= {threshold} THEN 'anomalies' ELSE 'metrics' END"


def scaled(source: str) -> str:
    """(event_id, s): the feature list of each row between the bounds of the fixed net."""
    x = ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)
    return f"""SELECT event_id, list_transform(range(1, 8), lambda i: (x[i] - lo[i]) / (hi[i] - lo[i])) AS s
FROM (SELECT event_id, [{x}] AS x, {AE_MINS} AS lo, {AE_MAXS} AS hi FROM {source}) v"""


def net_error(source: str) -> str:
    """(event_id, ae_mse) from (event_id, s): layer by layer, relu but for the last; weights and biases by their rule."""
    q = f"SELECT event_id, s, s AS h FROM ({source}) z"
    for layer, (n, m) in enumerate(zip(AE_WIDTHS, AE_WIDTHS[1:])):
        weight = f"((k * 7 + j * 3 + {layer * 5}) % 13 - 6) / 10.0"
        unit = (f"list_sum(list_transform(range(0, {n}), lambda k: h[k + 1] * CAST({weight} AS DOUBLE))) "
                f"+ CAST(((j * 5 + {layer}) % 7 - 3) / 20.0 AS DOUBLE)")
        if layer < len(AE_WIDTHS) - 2:
            unit = f"greatest({unit}, 0.0)"
        q = f"SELECT event_id, s, list_transform(range(0, {m}), lambda j: {unit}) AS h FROM ({q}) z{layer}"
    return f"SELECT event_id, list_sum(list_transform(range(1, 8), lambda i: (h[i] - s[i]) ** 2)) / 7 AS ae_mse FROM ({q}) out"


def forest_decision(source: str) -> str:
    """(event_id, d): every row walks the three trees; a leaf of n rows counts as the mean depth of a search among n."""
    c = "2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n}"
    return f"""
WITH RECURSIVE nodes(tree, node, feature, cut, no, yes, n) AS (VALUES
  (0, 0, 'amount', 150.0, 2, 1, 256), (0, 1, NULL, 0.0, 0, 0, 180), (0, 2, 'amount_ratio', 1.0, 4, 3, 76),
  (0, 3, NULL, 0.0, 0, 0, 50), (0, 4, NULL, 0.0, 0, 0, 26),
  (1, 0, 'is_transfer', 0.5, 2, 1, 256), (1, 1, 'hour_of_day', 12.0, 4, 3, 200), (1, 2, NULL, 0.0, 0, 0, 56),
  (1, 3, NULL, 0.0, 0, 0, 100), (1, 4, NULL, 0.0, 0, 0, 100),
  (2, 0, 'balance_diff_orig', -50.0, 2, 1, 256), (2, 1, NULL, 0.0, 0, 0, 20), (2, 2, 'amount', 300.0, 4, 3, 236),
  (2, 3, NULL, 0.0, 0, 0, 200), (2, 4, NULL, 0.0, 0, 0, 36)),
walk AS (
  SELECT event_id, tree, 0 AS node, 0 AS depth FROM {source}, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL
  SELECT w.event_id, w.tree, CASE WHEN CASE n.feature WHEN 'amount' THEN f.amount WHEN 'amount_ratio' THEN f.amount_ratio
      WHEN 'balance_diff_orig' THEN f.balance_diff_orig WHEN 'is_transfer' THEN f.is_transfer ELSE f.hour_of_day END <= n.cut
      THEN n.yes ELSE n.no END, w.depth + 1
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN {source} f ON f.event_id = w.event_id WHERE n.feature IS NOT NULL
)
SELECT event_id, 0.5 - 2 ** (-avg(depth + {c.format(n='n')}) / ({c.format(n='256')})) AS d
FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY event_id"""
