"""Data contract: column schemas, the ordered feature list and fixed values.

Everything that must equal the behaviour being reproduced (names, sets,
defaults, message texts) is stated here once, as plain values.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written: they are the contract).
# ---------------------------------------------------------------------------

# Ordered model input; order is part of the contract.
FEATURES_V1 = [
    "amount",
    "amount_ratio",
    "balance_diff_orig",
    "is_transfer",
    "is_cashout",
    "hour_of_day",
    "txn_velocity_1h",
]

# Fields that must never reach a model.
LEAKAGE_FIELDS = ["is_fraud", "isFraud", "label"]

# Transaction table columns, in order.
EXPECTED_COLUMNS = [
    "step",
    "type",
    "amount",
    "nameOrig",
    "oldbalanceOrg",
    "newbalanceOrig",
    "nameDest",
    "oldbalanceDest",
    "newbalanceDest",
    "isFraud",
    "isFlaggedFraud",
]

# Transaction types accepted by table validation (both spellings).
ALLOWED_TYPES = ["CASH-IN", "CASH-OUT", "CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
# Types fraud may occur in, after normalising '_' to '-'.
FRAUD_TYPES_NORMALISED = ["TRANSFER", "CASH-OUT"]
# Types fraud may occur in for the profile check (no normalisation).
ALLOWED_FRAUD_TYPES = ["TRANSFER", "CASH-OUT", "CASH_OUT"]
# Spellings counted as cash-out by the feature builder.
CASHOUT_SPELLINGS = ["CASH-OUT", "CASH_OUT"]

# Offline time base: hour counter `step` is added to this instant.
STEP_BASE = "2024-01-01 00:00:00"

# Validation messages and limits.
MSG_MISSING_COLUMNS = "Missing required columns: "
MSG_UNKNOWN_TYPES = "Unknown transaction types: "
MSG_FRAUD_OUTSIDE = "Found fraudulent rows outside TRANSFER/CASH-OUT."
MSG_FLAGGED_SPARSE = "isFlaggedFraud is sparse and should not be used as target."
MSG_STEP_START = "step must start at 1 or greater."
MSG_STEP_SMALL = "Maximum step is unexpectedly small; verify dataset completeness."
FLAGGED_SPARSE_MAX = 20
STEP_MIN_ALLOWED = 1
STEP_MAX_EXPECTED = 100

# Event parser messages.  "Invalid JSON payload" is our own stable text for a
# syntax error (the original used the JSON library's exception text).
MSG_INVALID_JSON = "Invalid JSON payload"
MSG_NOT_OBJECT = "Payload JSON must decode to an object."
MSG_MISSING_FIELDS = "Missing required fields: "

# Raw event schema v1 (JSON Schema, draft 2020-12), as data.
EVENT_SCHEMA_V1 = {
    "type": "object",
    "required": [
        "event_id",
        "timestamp",
        "user_id",
        "type",
        "amount",
        "old_balance_orig",
        "new_balance_orig",
    ],
    "properties": {
        "event_id": {"type": "string", "minLength": 1},
        "timestamp": {"type": "string", "minLength": 1},
        "user_id": {"type": "string", "minLength": 1},
        "type": {
            "type": "string",
            "enum": ["TRANSFER", "CASH-OUT", "PAYMENT", "CASH-IN", "DEBIT"],
        },
        "amount": {"type": "number", "minimum": 0},
        "old_balance_orig": {"type": "number", "minimum": 0},
        "new_balance_orig": {"type": "number", "minimum": 0},
    },
    "additionalProperties": True,
}

# Topics.
TOPIC_PARSED = "parsed-events"
TOPIC_FEATURES = "feature-events"
TOPIC_DLQ = "dead-letter"
TOPIC_ANOMALY = "anomalies"
TOPIC_NORMAL = "metrics"

# Scoring defaults.
DEFAULT_WEIGHTS = (0.4, 0.3, 0.3)
DEFAULT_THRESHOLD = 0.5
AE_THRESHOLD_EPS = 1e-12

# Adaptive threshold defaults.
ADAPTIVE_DEFAULTS = {
    "current_threshold": 0.5,
    "quantile": 0.995,
    "min_samples": 50,
    "floor": 0.05,
    "ceiling": 0.99,
}

# Feedback labels.
LABEL_POSITIVE = "true_positive"
LABEL_NEGATIVE = "false_positive"
FEEDBACK_FIELDS = ["anomaly_id", "label", "analyst_id", "features", "notes"]

# Online learning and promotion defaults.
ONLINE_BATCH_SIZE = 500
PROMOTION_MIN = {"precision": 0.10, "recall": 0.05, "pr_auc": 0.05}

# Training defaults.
IF_SAMPLE_SIZE = 200_000
IF_TREES = 200
IF_CONTAMINATION = 0.001291
IF_SUBSAMPLE = 256
AE_SAMPLE_SIZE = 200_000
AE_MAX_EPOCHS = 50
AE_LAYERS = (7, 5, 3, 5, 7)
SEED = 42
TRAIN_FRACTION = 0.8

# Alert rules (metric, range seconds, comparison, hold seconds, severity, service).
ALERT_RULES = [
    ("FeedbackPublishErrorsDetected", "feedback_publish_errors_total", 300, ">", 60, "warning", "feedback_api"),
    ("OnlineConsumerStalled", "online_consumer_messages_total", 300, "==", 600, "warning", "online_consumer"),
    ("PromotionFailuresDetected", "promotion_fail_total", 900, ">", 60, "critical", "online_consumer"),
    ("PromotionRollbacksDetected", "promotion_rollback_total", 900, ">", 60, "critical", "online_consumer"),
]

# ---------------------------------------------------------------------------
# Spark schemas.
# ---------------------------------------------------------------------------

TXN_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)

FEATURE_TYPES = {
    "amount": T.DoubleType(),
    "amount_ratio": T.DoubleType(),
    "balance_diff_orig": T.DoubleType(),
    "is_transfer": T.IntegerType(),
    "is_cashout": T.IntegerType(),
    "hour_of_day": T.IntegerType(),
    "txn_velocity_1h": T.IntegerType(),
}

SCORES_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("if_score", "ae_score", "sgd_score", "ensemble_score")]
)

DLQ_SCHEMA = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("raw_event", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("online_update_count", T.LongType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
