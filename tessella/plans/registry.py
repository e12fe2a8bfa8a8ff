"""Registers a query with its SQL twin: ``@query("name", sql)`` over ``(spark, root)``."""

from __future__ import annotations

from collections.abc import Callable

#: Shared relation in SQL: conversations in normal form (see operators.conversation.normalised).
CONVS = """convs0 AS (
  SELECT row_id, source,
    CASE WHEN len(images) > 0 THEN images WHEN image IS NOT NULL THEN [image] ELSE [] END AS images,
    list_transform(coalesce(conversations, []), lambda t: {'role': CASE t.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE t.role END,
                                                           'text': coalesce(t.value, '')}) AS raw
  FROM training_example),
convs AS (SELECT row_id, source, images, CASE WHEN raw[1].role <> 'user' THEN raw[2:] ELSE raw END AS turns FROM convs0)"""


def h_sql(salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{salt}:' || {key}::VARCHAR), 1, 8))::BIGINT"


class Registry:
    def __init__(self) -> None:
        self.calls: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            if name in self.calls:
                raise ValueError(f"{name} is registered twice")
            self.calls[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self.calls)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
