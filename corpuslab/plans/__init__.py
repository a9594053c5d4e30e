"""Queries over the standard tables, one module for each family of operators."""

import importlib
import pkgutil


def load() -> None:
    """Imports all modules of this package, which register their queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
