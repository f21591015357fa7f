"""Registered queries over the given tables, each beside its SQL oracle."""

from importlib import import_module

MODULES = (
    "tables_and_contracts",
    "cleaning",
    "summaries",
    "splits",
    "models",
    "scenarios",
    "explanation",
    "graphs",
    "learners",
    "forests",
)


def load() -> None:
    """Import every query module once, which fills the registry."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
