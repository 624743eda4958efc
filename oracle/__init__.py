"""Plain SQL statements that recompute every registered query in DuckDB.

Shared steps are named fragments (``t_*``); ``statement`` prepends the ones a
final SELECT needs.
"""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    assert name not in FRAGMENTS, name
    FRAGMENTS[name] = sql.strip()


def _uses(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(re.findall(r"\bt_\w+", sql)) if w in FRAGMENTS]


def statement(final: str) -> str:
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in _uses(sql):
            if name not in ordered:
                visit(FRAGMENTS[name])
                ordered.append(name)

    visit(final)
    if not ordered:
        return final.strip()
    parts = ",\n".join(f"{n} AS (\n{FRAGMENTS[n]}\n)" for n in ordered)
    return f"WITH {parts}\n{final.strip()}"
