"""A place for queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name; ``query`` adds a function, with its SQL if there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


#: Current profile rows in SQL.
CURRENT = "(select * from profiles where profile_id is not null qualify row_number() over (partition by profile_id order by revision desc nulls last, ingested_at desc nulls last) = 1)"
#: Pages without re-deliveries in SQL.
PAGES = "(select * from cv_pages where page_id is not null qualify row_number() over (partition by page_id order by ingested_at desc nulls last) = 1)"
