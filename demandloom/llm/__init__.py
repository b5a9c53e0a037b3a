"""Operators for preparing training text, and their queries.

Nothing else in the library imports this package; it may be removed as a whole.
"""

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = ("mixing", "decontaminate", "lines", "fingerprint", "quality", "toxicity", "chat", "extract", "secrets", "simhash", "negatives", "bpe", "lexical")

for _m in _MODULES:
    import_module(f".{_m}", __name__)

__all__ = ["ORACLES", "QUERIES"]
