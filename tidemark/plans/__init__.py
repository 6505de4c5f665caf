"""Every named query; importing this package fills the registry."""

from importlib import import_module

from .registry import REGISTRY

FAMILIES = ["time", "staging", "resampling", "joining", "summaries", "cleaning", "detection", "patterns", "spectra", "records", "testing", "learning", "streams", "missing", "relations"]
for _family in FAMILIES:
    import_module(f"{__name__}.{_family}")

__all__ = ["REGISTRY"]
