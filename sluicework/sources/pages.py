"""Pages of resources as a partitioned stream: one partition per (user, resource) that is being read.

The offset is a map of cursors: for each of at most ``window`` targets that are open, the page that comes next
and the attempt at it, and how many targets have been begun.  It is as large as the window, whatever the number
of targets.  The driver asks the provider only where a page's successor is; tasks fetch the pages.  Which pages
a batch holds, and which attempts were turned away, follows from its two offsets alone, so a batch that is run
again asks for the same pages, and a query that is restarted goes on from its checkpoint.
"""

from __future__ import annotations

import asyncio
import importlib
import inspect
from collections.abc import Iterable, Iterator, Mapping
from typing import Any, NamedTuple, Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The adapters that a deployment names together or not at all.
ADAPTERS = ("repository", "staging", "provider")


class Next(NamedTuple):
    """Where a page's successor is (None: it is the last); or that the provider's quota is exhausted."""

    cursor: str | None
    exhausted: bool = False


class Provider(Protocol):
    """What a connector offers; it is made anew in every process from the source's options."""

    def targets(self) -> list[tuple[str, str]]:
        """(user, resource) in the order in which they are to be read; must not change while a stream lives."""

    def follow(self, user: str, resource: str, cursor: str | None, size: int, attempt: int) -> Next:
        """The successor of the page at ``cursor`` (None: the first)."""

    def fetch(self, user: str, resource: str, cursor: str | None, size: int) -> Iterable[tuple]:
        """(document_key, source_version, staging_uri, content_hash, deleted) of the page at ``cursor``."""


class NoPages:
    """The empty provider."""

    def targets(self) -> list[tuple[str, str]]:
        return []


def load_factory(path: str, options: Mapping[str, str]) -> Any:
    """What the function ``module:function`` makes of the options; it may be a coroutine."""
    module, _, function = path.partition(":")
    if not module or not function:
        raise ValueError("an adapter must be named as module:function")
    made = getattr(importlib.import_module(module), function)(options)

    async def waited() -> Any:
        return await made

    return asyncio.run(waited()) if inspect.isawaitable(made) else made


def adapters(options: Mapping[str, str]) -> dict[str, Any] | None:
    """The adapters that ``options`` name: all of ``ADAPTERS`` or none; None is only right where ``allow_unsafe`` says so."""
    named = {k: options.get(k) for k in ADAPTERS}
    if any(named.values()) and not all(named.values()):
        raise ValueError(f"adapters are all or nothing: {', '.join(ADAPTERS)} must be named together")
    if all(named.values()):
        return {k: load_factory(v, options) for k, v in named.items()}
    if options.get("allow_unsafe", "false").lower() != "true":
        raise ValueError("adapters are required, or allow_unsafe")
    return None


class Page(InputPartition):
    def __init__(self, user: str, resource: str, cursor: str | None, number: int, attempt: int, exhausted: bool):
        self.user, self.resource, self.cursor, self.number, self.attempt, self.exhausted = user, resource, cursor, number, attempt, exhausted


class PageReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.size, self.window = int(options.get("page_size", "100")), max(1, int(options.get("window", "64")))
        self.seen: dict | None = None
        self._targets: list[tuple[str, str]] | None = None

    def provider(self) -> Any:
        return load_factory(self.options["provider"], self.options) if self.options.get("provider") else NoPages()

    def targets(self) -> list[tuple[str, str]]:
        if self._targets is None:
            self._targets = [tuple(t) for t in self.provider().targets()]
        return self._targets

    def initialOffset(self) -> dict:  # noqa: N802
        n = min(self.window, len(self.targets()))
        return {"begun": n, "open": {str(i): [None, 0, 1] for i in range(n)}}

    def latestOffset(self) -> dict:  # noqa: N802
        """One page, or one attempt, further for every open target; a target that has ended makes room for the next."""
        if self.seen is None:
            self.seen = self.initialOffset()
        provider, begun, still = self.provider(), self.seen["begun"], {}
        for i, (cursor, number, attempt) in self.seen["open"].items():
            told = provider.follow(*self.targets()[int(i)], cursor, self.size, attempt)
            if told.exhausted:
                still[i] = [cursor, number, attempt + 1]
            elif told.cursor is not None:
                still[i] = [told.cursor, number + 1, 1]
            elif begun < len(self.targets()):
                still[str(begun)] = [None, 0, 1]
                begun += 1
        self.seen = {"begun": begun, "open": still}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """The pages at ``start``'s cursors.  With two equal offsets the engine tells where it goes on."""
        if start == end:
            self.seen = end
            return []
        out = []
        for i, (cursor, number, attempt) in start["open"].items():
            away = end["open"].get(i, [None, -1, 0])[1:] == [number, attempt + 1]
            out.append(Page(*self.targets()[int(i)], cursor, number, attempt, away))
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        p = partition
        head = (p.user, p.resource, p.number, p.cursor, p.attempt)
        if p.exhausted:
            yield (*head, True, None, None, None, None, None)
            return
        for ordinal, (key, version, uri, digest, deleted) in enumerate(self.provider().fetch(p.user, p.resource, p.cursor, self.size)):
            yield (*head, False, ordinal, key, "delete" if deleted else "upsert", f"deleted:{p.cursor or 'initial'}" if deleted else version, None if deleted else (uri, digest))


class ResourcePages(DataSource):
    """``format("resource_pages")``: the manifest entries of all pages, and a row for each attempt that the quota turned away.

    Options: ``provider`` (``module:function``, a function of the options; without it there are no pages),
    ``page_size``, ``window`` (targets that are open at once).  Naming one of the other adapters as well means that
    all must be named.  Register with ``spark.dataSource.register(ResourcePages)``.
    """

    @classmethod
    def name(cls) -> str:
        return "resource_pages"

    def schema(self) -> str:
        return "user_key string, resource_key string, page_no long, cursor string, attempt long, quota_exhausted boolean, ordinal long, document_key string, mutation string, source_version string, body struct<staging_uri: string, content_hash: string>"

    def streamReader(self, schema: StructType) -> PageReader:  # noqa: N802
        if self.options.get("repository") or self.options.get("staging"):
            adapters(self.options)
        return PageReader(self.options)
