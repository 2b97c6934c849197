"""A store's users behind a cursor, a page for each micro-batch; pages of resources are read by partitions, see ``pages``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class PagedReader(SimpleDataSourceStreamReader):
    """One page per micro-batch; the offset is the page's cursor and the attempt at it, as a page whose quota is exhausted is asked for again."""

    def __init__(self, fetch: Callable[[str | None, int], tuple[list[tuple], str | None, bool]], size: int):
        self.fetch, self.size = fetch, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": None, "attempt": 1, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        rows, cursor, exhausted = self.fetch(start["cursor"], self.size)
        if exhausted:
            return iter(()), start | {"attempt": start["attempt"] + 1}
        return iter(rows), {"cursor": cursor, "attempt": 1, "done": cursor is None}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        away = start["cursor"] == end["cursor"] and not end["done"]
        return iter(()) if away else iter(self.fetch(start["cursor"], self.size)[0])

    def commit(self, end: dict) -> None:
        pass


class UserPages(DataSource):
    """``format("user_pages")``: users of a store from a provider named by the option ``provider`` (``module:function``).

    The function takes (cursor or None, page size) and returns (rows of user_key and valid, next cursor or
    None, whether the quota is exhausted).  Options must name it fully or the source fails to load.
    """

    @classmethod
    def name(cls) -> str:
        return "user_pages"

    def schema(self) -> str:
        return "user_key string, valid boolean"

    def simpleStreamReader(self, schema: StructType) -> PagedReader:  # noqa: N802
        import importlib

        module, _, function = self.options.get("provider", "").partition(":")
        if not module or not function:
            raise ValueError("option provider must be module:function")
        return PagedReader(getattr(importlib.import_module(module), function), int(self.options.get("page_size", "100")))
