"""Registered queries over the test tables, each beside its SQL."""
from . import (audits, cleaning, evaluation, features, files, lists, models, records, resampling,  # noqa: F401
               spatial, streams)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
