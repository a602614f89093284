"""Versioned operator catalogs."""

from __future__ import annotations

from functools import lru_cache

from ..plans.model import Catalog, OperatorSpec
from . import across, elementwise, pairs, paths, rolling

# Catalog versions, and what each adds to the base operators.
VERSIONS = {
    "astock_formula_ops_v3": (),
    "astock_formula_ops_v4_stateful": ("state",),
    "astock_formula_ops_v5_path": ("path",),
    "astock_formula_ops_v6_production": ("stable",),
    "astock_formula_ops_v7_production_path": ("stable", "path"),
    "astock_formula_ops_v8_production_event": ("stable", "event"),
    "astock_formula_ops_v9_experimental_robust_path": ("stable", "path", "event", "robust"),
    "astock_formula_ops_v10_experimental_group": ("stable", "event", "group"),
}
PRODUCTION = "astock_formula_ops_v6_production"
#: Versions that production jobs may name.
FOR_JOBS = tuple(v for v in VERSIONS if "production" in v)
_EXTRA = {"state": elementwise.STATE, "path": paths.PATHS, "event": paths.EVENTS, "robust": (*rolling.ROBUST, *paths.RUNS, *pairs.REGRESSION), "group": across.GROUPS}


@lru_cache
def catalog(version: str = PRODUCTION) -> Catalog:
    if version not in VERSIONS:
        raise ValueError(f"unknown operator catalog {version}")
    parts = VERSIONS[version]
    base = (*elementwise.ARITHMETIC, *elementwise.COMPARISONS, *elementwise.CHOICES, *across.cross_section(across.stable_rank if "stable" in parts else across.plain_rank), *rolling.ROLLING, *pairs.PAIRS)
    return Catalog(version, (*base, *(s for p in parts for s in _EXTRA.get(p, ()))))


def extended(version: str, base: Catalog, *specs: OperatorSpec) -> Catalog:
    """A catalog with operators of your own beside those of ``base``. Its version is part of the identity of every factor."""
    return Catalog(version, (*base.specs.values(), *specs))


@lru_cache
def everything() -> Catalog:
    """All operators, with the production rank."""
    return Catalog("factorspark_all_v1", (*catalog().specs.values(), *(s for p in _EXTRA.values() for s in p)))
