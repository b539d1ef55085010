"""Queries over the driver's tables; importing a module registers its queries."""

import importlib
import pkgutil

MODULES = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")]
