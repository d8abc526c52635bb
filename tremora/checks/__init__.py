"""Registered queries; importing the modules fills the registry."""

from importlib import import_module

MODULES = ("catalog_queries", "statistics_queries", "feature_queries", "model_queries", "region_queries", "io_queries", "plan_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tremora.checks.{name}")
