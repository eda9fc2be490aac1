"""DuckDB SQL that says independently what each query returns."""

from __future__ import annotations

import re

from tidemark.oracle.models import MODEL_SQL
from tidemark.sources.raw import PROJECTION, TABLES

_SHARED = {k: v.format(**{t: t for t in (*TABLES, *PROJECTION)}) for k, v in PROJECTION.items()}


def complete(sql: str) -> str:
    """sql with the common table expressions of every raw table and model that it names."""
    have = _SHARED | MODEL_SQL
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if name in have and name not in order:
                visit(have[name])
                order.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({have[n]})" for n in order)
    if not ctes:
        return sql
    body = re.match(r"\s*WITH(\s+RECURSIVE)?\s+(.*)", sql, re.DOTALL)
    if body:
        return f"WITH{body[1] or ''} {ctes}, {body[2]}"
    return f"WITH {ctes} {sql}"
