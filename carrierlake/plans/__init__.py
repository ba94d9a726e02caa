"""Registered queries: each pairs a Spark plan over the driver tables with its SQL oracle."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every module of this package so that its queries register."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
