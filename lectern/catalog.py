"""All queries of the core, with the SQL that gives the same result where there is one."""

from __future__ import annotations

from lectern.plans import anchors, jobs, matching, more, records, records_sql, relational

QUERIES = {**records.QUERIES, **anchors.QUERIES, **relational.QUERIES, **matching.QUERIES, **more.QUERIES, **jobs.QUERIES}
SQL = {**records_sql.SQL, **anchors.SQL, **relational.SQL, **matching.SQL, **more.SQL, **jobs.SQL}
