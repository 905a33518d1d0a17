"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import casework, flagging, folders, geometry, grids, headings, pages, records, screening, texts

FLAGSHIP = screening.QUERIES["screening_outcome"]
QUERIES = {**screening.QUERIES, **flagging.QUERIES, **casework.QUERIES, **texts.QUERIES, **geometry.QUERIES, **grids.QUERIES, **folders.QUERIES, **pages.QUERIES, **headings.QUERIES, **records.QUERIES}
ORACLE = {**screening.ORACLE, **flagging.ORACLE, **casework.ORACLE, **texts.ORACLE, **geometry.ORACLE, **grids.ORACLE, **folders.ORACLE, **pages.ORACLE, **headings.ORACLE, **records.ORACLE}
