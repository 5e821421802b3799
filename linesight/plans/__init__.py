"""Named queries over the driver tables and their DuckDB oracles."""

from importlib import import_module

_MODULES = ["localization", "effort", "classify", "runs", "generated", "evaluation", "cleaning", "matching", "functions", "sampling", "learning", "io", "streams"]


def load_all():
    for m in _MODULES:
        import_module(f"linesight.plans.{m}")
    from linesight.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
