"""Final statements by query name, cast to the registered output schema."""

from retailflow.plans.registry import SPECS, SQL_TYPES

FINALS: dict[str, str] = {}  # without the fragments they use


def final(name: str, sql: str) -> None:
    assert name not in FINALS, name
    columns = ", ".join(f'CAST("{c}" AS {SQL_TYPES[t]}) AS "{c}"' for c, t in SPECS[name])
    FINALS[name] = f"SELECT {columns} FROM (\n{sql.strip()}\n)"
