"""Imports every query module so that the registry is complete."""

import importlib

from barloom.plans.registry import ORACLES, QUERIES

MODULES = ("queries_data", "queries_features", "queries_eval", "queries_models")
for _name in MODULES:
    importlib.import_module(f"barloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
