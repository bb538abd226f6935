"""Imports every query module, which fills the registry."""

import importlib
import pkgutil

from strandline import plans
from strandline.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("family_")):
    importlib.import_module(f"strandline.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
