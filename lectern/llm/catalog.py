"""The queries of this folder and their SQL."""

from lectern.llm import language, link, mix, normal, pack, pii, scans, split

_ALL = [pii, link, language, normal, scans, pack, mix, split]
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
