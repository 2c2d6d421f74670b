"""Named queries. Importing a plan module registers its queries."""

import importlib
import pkgutil

from rentroll.plans.registry import REGISTRY


def load():
    for module in pkgutil.walk_packages(__path__, f"{__name__}."):
        importlib.import_module(module.name)
    return REGISTRY
