"""DuckDB oracle SQL for the file source/sink queries."""

from __future__ import annotations

from riskflow.contract import FEATURES_V1
from riskflow.plans import feedback_oracle as FO
from riskflow.plans import table_oracle
from riskflow.plans.oracle_views import with_views

R = 9
ACCEPTED = f"anomaly_id, accepted, y, skip_reason, {', '.join(f'round({n}, {R}) AS {n}' for n in FEATURES_V1)}"


def oracle() -> dict[str, str]:
    return {
        "txn_csv_validation": table_oracle.oracle()["table_validation"],
        "feedback_jsonl_accept": with_views(["feedback_text"], [FO.FB_PARSED, FO.ACCEPT], f"""
SELECT {ACCEPTED} FROM fba WHERE event_id IN (SELECT event_id FROM fbp WHERE decode_error IS NULL)"""),
        "feedback_dead_lines": with_views(["feedback_text"], [FO.FB_PARSED], """
SELECT raw, decode_error AS error FROM fbp WHERE decode_error IS NOT NULL"""),
        "feedback_publish_accept": with_views(["feedback_text"], [FO.FB_PARSED, FO.ACCEPT, FO.VALIDATED], f"""
SELECT {ACCEPTED} FROM fba WHERE event_id IN (SELECT event_id FROM fbv WHERE status = 'accepted')"""),
        "feedback_publish": with_views(["feedback_text"], [FO.FB_PARSED, FO.VALIDATED], """
SELECT CAST(count(*) AS DOUBLE) AS feedback_requests_total, CAST(count(*) AS DOUBLE) AS feedback_published_total,
  CAST(0 AS DOUBLE) AS feedback_publish_errors_total
FROM fbv WHERE status = 'accepted'"""),
    }
