"""Named queries over the given tables."""

from importlib import import_module

MODULES = ("q_core", "q_ledger", "q_docs")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
