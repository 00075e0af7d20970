"""Spark schemas of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ALERT = _struct(
    alertname=S, severity=S, fingerprint=S, summary=S, description=S, labels=T.MapType(S, S)
)

# The file layout uses camelCase for two fields; the tables use snake_case.
SCENARIO_FILE = _struct(
    name=S, question=S, rubric=S, source=S, alert=ALERT,
    logSamples=T.ArrayType(S), logEnvironment=S, expected=S, axis=S,
)
SCENARIO = _struct(
    seq=L, name=S, question=S, rubric=S, source=S, alert=ALERT,
    log_samples=T.ArrayType(S), log_environment=S, expected=S,
)
CANDIDATE = _struct(
    seq=L, name=S, question=S, rubric=S, source=S, alert=ALERT,
    log_samples=T.ArrayType(S), log_environment=S, expected=S, axis=S,
    present=T.ArrayType(S),
)
LOG_LINE = _struct(seq=L, ts_ns=L, line=S)
ALERT_RULE = _struct(seq=L, name=S, severity=S, summary=S, description=S)
OUTPUT = _struct(arm=S, scenario=S, sample_idx=I, raw=S)
ANALYSIS = _struct(
    summary=S, root_cause_hypothesis=S, suggested_actions=T.ArrayType(S),
    evidence_found=B, evidence_line=S,
)
JUDGE_SCORE = _struct(
    accuracy=I, groundedness=I, hallucination_detected=B, verdict=S, rationale=S
)
TRIAL = _struct(
    run=S, scenario=S, trial=I, answer=S, accuracy=I, groundedness=I,
    hallucination_detected=B, verdict=S, rationale=S, latency_ms=L, error=S,
)
SCORE = _struct(arm=S, scenario=S, kind=S, sample_idx=I, value=D)
CHAT = _struct(
    split=S, line_no=L, messages=T.ArrayType(_struct(role=S, content=S))
)
SPLITS = T.MapType(S, T.ArrayType(S))

#: sample_idx of the deterministic answer; sampled answers count from 0.
GREEDY = -1


@dataclass(frozen=True)
class RewardSpec:
    """Weights of the verifiable reward."""

    schema: float = 0.10
    verdict: float = 0.50
    citation: float = 0.40
    specificity: float = 0.0
    cause_without_evidence: float = 0.30
