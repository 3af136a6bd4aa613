"""The table catalog: definitions, in memory and in a JSON or TOML file."""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from dataclasses import asdict, dataclass, field

from marlstone.errors import InvalidConfigError, PlanningError, StorageError

FORMATS = ("parquet", "index")


@dataclass
class TableDef:
    """``paths`` wins over ``uri``.  ``schema`` is a list of (name, Spark type) or None: inferred."""

    name: str
    uri: str = ""
    paths: list[str] = field(default_factory=list)
    format: str = "parquet"
    schema: list[tuple[str, str]] | None = None
    rows: int | None = None
    bytes: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise InvalidConfigError("a table needs a name")
        if self.format not in FORMATS:
            raise InvalidConfigError(f"table {self.name}: format is one of {FORMATS}, not {self.format!r}")
        if self.format == "parquet" and not (self.uri or self.paths):
            raise InvalidConfigError(f"table {self.name}: needs uri or paths")
        if self.schema is not None:
            self.schema = [tuple(c) for c in self.schema]

    def locations(self) -> list[str]:
        return list(self.paths) if self.paths else [self.uri]


class Catalog:
    def __init__(self, path: str | None = None):
        self.path = path
        self.tables: dict[str, TableDef] = {}
        if path and os.path.exists(path):
            self.load(path)

    def register(self, table: TableDef) -> None:
        self.tables[table.name] = table

    def get(self, name: str) -> TableDef:
        if name not in self.tables:
            raise PlanningError(f"unknown table {name!r}; there are: {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[name]

    def names(self) -> list[str]:
        return sorted(self.tables)

    def load(self, path: str) -> None:
        """A list of tables, or an object with them under ``tables``."""
        try:
            with open(path, "rb") as f:
                data = tomllib.load(f) if path.endswith(".toml") else json.load(f)
        except OSError as e:
            raise StorageError(f"catalog {path}: {e}") from e
        except ValueError as e:
            raise InvalidConfigError(f"catalog {path}: {e}") from e
        for entry in data["tables"] if isinstance(data, dict) else data:
            try:
                self.register(TableDef(**entry))
            except TypeError as e:
                raise InvalidConfigError(f"catalog {path}: {e}") from e

    def save(self, path: str | None = None) -> None:
        """Written beside the file, then put in its place, so readers see all or nothing."""
        path = path or self.path
        if not path:
            return
        entries = [{k: v for k, v in asdict(t).items() if v not in (None, [], {}, "")} for _, t in sorted(self.tables.items())]
        text = _toml(entries) if path.endswith(".toml") else json.dumps({"tables": entries}, indent=2)
        stage = f"{path}.{uuid.uuid4().hex}.stage"
        try:
            with open(stage, "w") as f:
                f.write(text)
            os.replace(stage, path)
        except OSError as e:
            raise StorageError(f"catalog {path}: {e}") from e
        finally:
            if os.path.exists(stage):
                os.remove(stage)


def _toml(entries: list[dict]) -> str:
    lines = []
    for entry in entries:
        lines.append("[[tables]]")
        lines += [f"{k} = {json.dumps(v)}" for k, v in entry.items() if not isinstance(v, dict)]
        for k, v in entry.items():
            if isinstance(v, dict):
                lines.append(f"[tables.{k}]")
                lines += [f"{json.dumps(a)} = {json.dumps(b)}" for a, b in v.items()]
    return "\n".join(lines) + "\n"
