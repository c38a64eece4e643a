"""Whole analyses composed from the operators, and the registered queries."""

from importlib import import_module

MODULES = ("feature_queries", "profile_queries", "model_queries", "graph_queries")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"riskloom.plans.{name}")
