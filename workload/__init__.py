"""Queries over the given tables, one or more per operator, each with the SQL it must agree with."""

from workload import audits, claims, logs, records, streams, texts, tracks

MODULES = [texts, claims, audits, logs, tracks, records, streams]

RUNS = {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
