"""Spectraloom: a Spark-native engine for quantitative-omics tables.

Readers and the namespaces ``pp`` (processing), ``tl`` (analysis), ``pl`` (tables behind plots), ``io`` and ``utils`` are
loaded when they are first used.
"""

from importlib import import_module

_READERS = ("read_sage", "read_diann", "read_fragpipe", "read_maxquant", "read_comet", "read_protdiscov")
_MODULES = ("pp", "tl", "pl", "io", "utils")


def __getattr__(name: str):
    if name in _MODULES:
        return import_module(f"{__name__}.{name}")
    if name in _READERS:
        return getattr(import_module(f"{__name__}.sources.readers"), name)
    if name == "merge_studies":
        return import_module(f"{__name__}.operators.merge").merge_studies
    if name in ("Study", "Assay", "save", "load"):
        return getattr(import_module(f"{__name__}.model"), name)
    raise AttributeError(f"{__name__} has no {name}")
