"""The registry of queries, and the DuckDB views that their SQL starts from."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: name -> (names it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def with_views(names: str, body: str) -> str:
    """body after a WITH clause of these views and all that they need, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for x in VIEWS[name][0]:
                add(x)
            done[name] = VIEWS[name][1]

    for n in names.split():
        add(n)
    if not done:
        return body
    body = body.strip()
    more = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return "WITH RECURSIVE " + ", ".join(f"{k} AS {'MATERIALIZED ' * (k in ('g', 'tri'))}({v})" for k, v in done.items()) + more


def query(name: str, sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql)
        return f

    return add
