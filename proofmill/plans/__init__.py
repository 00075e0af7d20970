"""The registered queries: operators applied to tables derived from the driver's."""

from . import q_curation, q_metrics, q_outputs, q_replay, q_training  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
