"""Registered queries by area."""

import importlib
import pkgutil


def load():
    from trialgrid.plans import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry
