"""The registered queries, one module for each part of the library."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Imports every module here, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
