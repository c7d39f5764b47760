"""A batch of state requests, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkwarden.operators.trace import validation_events
from sparkwarden.operators.transitions import judge_requests, move_states
from sparkwarden.session import cut_lineage


@dataclass(frozen=True)
class Transitions:
    outcomes: DataFrame
    backlog: DataFrame
    trace: DataFrame


def apply_requests(backlog: DataFrame, log: DataFrame) -> Transitions:
    """Judge the requests once, then derive the new backlog and the validation events."""
    outcomes = cut_lineage(judge_requests(backlog, log))
    return Transitions(outcomes, move_states(backlog, outcomes), validation_events(outcomes))
