"""The registered queries as DuckDB SQL, for comparison."""

from __future__ import annotations

import textwrap

from checks import file_sql, interval_sql, layout_sql, segment_sql, stream_sql, text_sql

MODULES = [interval_sql, layout_sql, text_sql, segment_sql, file_sql, stream_sql]


def _with(upto: str | None, parts: dict[str, str]) -> str:
    names = list(parts)
    used = names[: names.index(upto) + 1] if upto else []
    return ",\n".join(f"{n} AS ({textwrap.dedent(parts[n])})" for n in used)


def oracle_sql() -> dict[str, str]:
    """Named parts go before each select; each part may use the ones before it."""
    parts: dict[str, str] = {}
    for module in MODULES:
        parts.update(module.PARTS)
    out = {}
    for module in MODULES:
        for name, (upto, select) in module.QUERIES.items():
            head = f"WITH {_with(upto, parts)}\n" if upto else ""
            out[name] = head + select
        for name, (upto, head, select) in getattr(module, "RECURSIVE", {}).items():
            out[name] = head.replace("{parts}", _with(upto, parts)) + select
    for name in file_sql.TWO_RATES:
        out[name] = file_sql.at_two_rates(out[name])
    return out
