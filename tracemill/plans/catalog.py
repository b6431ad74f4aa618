"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from tracemill.plans import behavior, checks, content, corpus, experiments, flows, rollouts, sequences, training_core

MODULES = [training_core, behavior, experiments, sequences, content, flows, rollouts, corpus, checks]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
