"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from tessera.plans import atlas, basic, cohort, evidence, labels, programs, regions, spatial

_MODULES = (basic, spatial, regions, programs, cohort, labels, evidence, atlas)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
