"""Every query of the library and its SQL, gathered from the modules in plans."""

from __future__ import annotations

from cutroom.plans import autoselect, basics, delivery, library, media, pictures, pool, reads, records, relational, scalars, selection, sound, storage, text, timelines, vectors

_MODULES = (relational, timelines, vectors, selection, text, library, pool, delivery, autoselect, media, scalars, records, sound, pictures, storage, reads, basics)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
