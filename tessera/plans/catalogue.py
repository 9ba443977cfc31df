"""All queries of the engine by name, with their DuckDB twins."""

from tessera.plans import call_plans, corpus_plans, more_plans, other_plans, state_plans

PARTS = (corpus_plans, call_plans, other_plans, more_plans, state_plans)
QUERIES: dict = {name: f for p in PARTS for name, f in p.QUERIES.items()}
ORACLES: dict = {name: sql for p in PARTS for name, sql in p.ORACLES.items()}
