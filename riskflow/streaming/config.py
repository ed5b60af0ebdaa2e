"""Run configuration of the stream jobs (T3): topics, source, threshold, weights, models; read from the environment.

A value that no job could run with is refused when the configuration is made, not when a stream reaches it.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from riskflow.contract import DEFAULT_THRESHOLD, DEFAULT_WEIGHTS, TOPIC_ANOMALY, TOPIC_DLQ, TOPIC_FEATURES, TOPIC_NORMAL
from riskflow.sources.payloads import SourceOptions

# The environment variable of each text setting.
ENV_TOPICS = {
    "raw_topic": "RAW_EVENTS_TOPIC",
    "valid_topic": "FEATURE_EVENTS_TOPIC",
    "anomaly_topic": "ANOMALIES_TOPIC",
    "normal_topic": "METRICS_TOPIC",
    "dlq_topic": "DLQ_TOPIC",
}


@dataclass(frozen=True)
class StreamConfig:
    raw_topic: str = "raw-events"
    valid_topic: str = TOPIC_FEATURES
    anomaly_topic: str = TOPIC_ANOMALY
    normal_topic: str = TOPIC_NORMAL
    dlq_topic: str = TOPIC_DLQ
    score_threshold: float = DEFAULT_THRESHOLD
    weights: tuple = tuple(DEFAULT_WEIGHTS)
    model_root: str | None = None  # folder of the model registry; without it events are parsed and enriched only
    source: SourceOptions = SourceOptions()

    def __post_init__(self):
        names = [getattr(self, f) for f in ENV_TOPICS]
        if not all(names):
            raise ValueError("a topic needs a name")
        if len(set(names)) < len(names):
            raise ValueError(f"topics must differ: {names}")
        if not 0.0 <= self.score_threshold <= 1.0:
            raise ValueError("score_threshold must be in [0, 1]")

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> "StreamConfig":
        """Settings given in the environment (or another mapping); the others keep their defaults."""
        e = os.environ if env is None else env
        given = {f: e[name] for f, name in ENV_TOPICS.items() if name in e}
        if "ANOMALY_THRESHOLD" in e:
            given["score_threshold"] = float(e["ANOMALY_THRESHOLD"])
        if "MODEL_ROOT" in e:
            given["model_root"] = e["MODEL_ROOT"]
        return StreamConfig(source=SourceOptions.from_env(e), **given)
