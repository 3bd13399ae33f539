"""Composed flows and the registered queries."""

from importlib import import_module

MODULES = ["bar_queries", "structure_queries", "quality_queries", "outcome_queries", "signal_queries", "ledger_queries", "source_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tickloom.plans.{name}")
