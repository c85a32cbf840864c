"""A registry of named operators, and the protocols of its pluggable parts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame


class Chunker(Protocol):
    """From files (path, content) to chunks (path, start_line, end_line, text)."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class Mapper(Protocol):
    """From blocks and definitions to entities (block_id, path, qualname)."""

    def __call__(self, blocks: DataFrame, definitions: DataFrame) -> DataFrame: ...


class UnknownOperator(LookupError):
    pass


class CommandError(RuntimeError):
    """What an operator raised as ValueError: the caller's arguments are at fault."""


class Registry:
    """name -> builder(tables, **arguments) -> DataFrame."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, builder: Callable[..., DataFrame]) -> None:
        if name in self._builders:
            raise ValueError(f"{name} is registered already")
        self._builders[name] = builder

    def names(self) -> list[str]:
        return sorted(self._builders)

    def run(self, name: str, *tables: DataFrame, **arguments) -> DataFrame:
        if name not in self._builders:
            raise UnknownOperator(f"unknown operator {name}; there are {', '.join(self.names())}")
        try:
            return self._builders[name](*tables, **arguments)
        except ValueError as e:
            raise CommandError(f"{name}: {e}") from e
