"""A registry of queries: each entry pairs a DataFrame plan with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    section: str


class Registry:
    """Named queries in order of registration; a name is given once."""

    def __init__(self) -> None:
        self._found: dict[str, Query] = {}

    def add(self, name: str, section: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            if name in self._found:
                raise ValueError(f"query {name} is registered twice")
            self._found[name] = Query(name, plan, sql, section)
            return plan

        return keep

    def plans(self) -> dict[str, Plan]:
        return {q.name: q.plan for q in self._found.values()}

    def sql(self) -> dict[str, str]:
        return {q.name: q.sql for q in self._found.values() if q.sql}

    def sections(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for q in self._found.values():
            out.setdefault(q.section, []).append(q.name)
        return out


REGISTRY = Registry()
