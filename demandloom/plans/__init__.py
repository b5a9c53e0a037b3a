"""All registered queries; importing the package fills the catalogue."""

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = ("facts", "explore", "series", "evaluate", "forecasting", "hierarchy", "report", "text", "sheets", "govern", "governance")

for _m in _MODULES:
    import_module(f".{_m}", __name__)

__all__ = ["ORACLES", "QUERIES"]
