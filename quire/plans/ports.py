"""What a program may put in the place of the library's own parts, and how parts are stacked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.model import Parsed

from .telemetry import LOG, counted


class SourcePolicy(Protocol):
    """Which sources may be read: a condition on a column of sources."""

    def allowed(self, source: Column) -> Column: ...


class Retriever(Protocol):
    """From sources (source, profile) to resources (source, media_type, bytes, metadata)."""

    def retrieve(self, sources: DataFrame) -> DataFrame: ...


class Parser(Protocol):
    """One resource's bytes, source and metadata to its sections; raises ParseError."""

    def __call__(self, data: bytes, source: str, metadata: dict[str, str]) -> Parsed: ...


class ResourceCache(Protocol):
    """Raw or parsed rows by key."""

    def get(self, keys: DataFrame) -> DataFrame: ...

    def put(self, rows: DataFrame) -> None: ...


class Repository(Protocol):
    """Stored tables by document; Store and MemoryStore are ones."""

    def table(self, name: str, document_id: str | None = None) -> DataFrame: ...

    def put(self, parsed: DataFrame) -> None: ...

    def ensure(self) -> None: ...


class SearchIndex(Protocol):
    """Ranked units for queries (query_id, query)."""

    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...


class Credentials(Protocol):
    """The bearer token of a profile, for hosts that the profile names."""

    def token(self, profile: str, host: str) -> str | None: ...


Stage = Callable[[DataFrame], DataFrame]


def stacked(*stages: Stage) -> Stage:
    """Stages one after another, the first nearest to the source."""
    return lambda df: reduce(lambda at, stage: stage(at), stages, df)


def budgeted(max_bytes: int, column: str = "bytes") -> Stage:
    """Rows whose body isn't larger than the budget; larger ones never reach a parser."""
    return lambda df: df.where(F.octet_length(column) <= max_bytes)


def watched(name: str) -> Stage:
    """Passes rows on, and says that it does; counts appear when an action has run."""

    def stage(df: DataFrame) -> DataFrame:
        LOG.info('{"event": "stage", "name": "%s"}', name)
        return counted(df, name)[0]

    return stage
