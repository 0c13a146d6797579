"""Column and table names of files, made into plain identifiers."""

from __future__ import annotations

import re

#: Words of SQL that a name must not be.
KEYWORDS = frozenset(
    """abort action add after all alter analyze and as asc attach autoincrement before begin between by cascade case cast
    check collate column commit conflict constraint create cross current_date current_time current_timestamp database
    default deferrable deferred delete desc detach distinct drop each else end escape except exclusive exists explain fail
    for foreign from full glob group having if ignore immediate in index indexed initially inner insert instead intersect
    into is isnull join key left like limit match natural no not notnull null of offset on or order outer plan pragma
    primary query raise recursive references regexp reindex release rename replace restrict right rollback row savepoint
    select set table temp temporary then to transaction trigger union unique update using vacuum values view virtual when
    where with without""".split()
)


def _clean(name: str | None, empty: str, digit_prefix: str, keyword_suffix: str) -> str:
    cleaned = re.sub(r"[^a-zA-Z0-9]", "_", (name or "").strip())
    if not cleaned:
        return empty
    if cleaned[0].isdigit():
        cleaned = digit_prefix + cleaned
    return cleaned + keyword_suffix if cleaned.lower() in KEYWORDS else cleaned


def column_name(name: str | None) -> str:
    return _clean(name, "unnamed_column", "col_", "_col")


def table_name(name: str | None) -> str:
    return _clean(name, "data", "table_", "_table")


def sheet_name(name: str) -> str:
    """Letters, digits and underscores of a sheet's name."""
    kept = "".join(c for c in name.strip().replace(" ", "_").replace("-", "_") if c.isalnum() or c == "_")
    return f"sheet_{kept}" if not kept or kept[0].isdigit() else kept


def column_names(names: list[str | None]) -> list[str]:
    """Clean names, repeated ones numbered from _1."""
    seen: dict[str, int] = {}
    out = []
    for n in map(column_name, names):
        k = seen.get(n.lower(), -1) + 1
        seen[n.lower()] = k
        out.append(f"{n}_{k}" if k else n)
    return out
