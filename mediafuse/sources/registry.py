"""Sources as plug-ins: descriptors, validation of families, and the union of what they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

ORIGIN = re.compile(r"[a-z0-9][a-z0-9-]{0,31}\Z")
NAME_LENGTH = 64
KINDS = ("media", "search", "season", "episodes")
Reader = Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    """What a source is, and a reader (spark, params) for each kind of record that it has."""

    origin: str
    name: str
    origin_url: str = ""
    icon: str | None = None
    color: str | None = None
    is_api_only: bool = False
    metadata_only: bool = False
    score: float = 0.0
    readers: dict[str, Reader] = field(default_factory=dict)


class Rejected(ValueError):
    """A source, or a whole family, that cannot be registered."""


def validated(source: Source) -> Source:
    if not ORIGIN.match(source.origin):
        raise Rejected(f"origin {source.origin!r} is malformed")
    if not source.name.strip():
        raise Rejected(f"{source.origin} has no name")
    if unknown := set(source.readers) - set(KINDS):
        raise Rejected(f"{source.origin} reads unknown kinds {sorted(unknown)}")
    return Source(**{**source.__dict__, "name": source.name.strip()[:NAME_LENGTH]})


class Registry:
    def __init__(self) -> None:
        self._families: dict[str, list[Source]] = {}

    @property
    def sources(self) -> list[Source]:
        return [s for family in self._families.values() for s in family]

    def register(self, plugin: str, family: list[Source]) -> list[str]:
        """Replaces what the plug-in had. Bad or taken origins are left out and returned as messages; none left is an error."""
        taken = {s.origin for name, other in self._families.items() if name != plugin for s in other}
        kept, messages = [], []
        for source in family:
            try:
                good = validated(source)
                if good.origin in taken:
                    raise Rejected(f"origin {good.origin!r} is taken")
            except Rejected as why:
                messages.append(str(why))
            else:
                taken.add(good.origin)
                kept.append(good)
        if not kept:
            raise Rejected("; ".join(messages) or "the family is empty")
        self._families[plugin] = kept
        return messages

    def unregister(self, plugin: str) -> None:
        self._families.pop(plugin, None)

    def read(self, spark: SparkSession, kind: str, **params) -> DataFrame | None:
        """The union of what all sources of that kind read, each held to its own origin.

        A source whose reader fails contributes nothing; failures are on ``failures``.
        """
        self.failures: dict[str, str] = {}
        parts = []
        for source in self.sources:
            if reader := source.readers.get(kind):
                try:
                    rows = reader(spark, **params)
                    parts.append(rows.where(rows["origin"] == source.origin))
                except Exception as why:  # noqa: BLE001  one source must not fail the page
                    self.failures[source.origin] = str(why).splitlines()[0]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
