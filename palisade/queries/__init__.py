"""Registered queries: (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from . import fields, geometry, loops, outcomes, pages, replies, session, store, streams, text, words

MODULES = [text, geometry, fields, replies, loops, outcomes, pages, session, store, streams, words]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in MODULES for n, s in m.ORACLE.items()}
