"""The parts of a model, as plain immutable data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class BadRequest(ValueError):
    """A request that names what doesn't exist or isn't allowed; ``status`` is the HTTP status it would get."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


class ModelError(ValueError):
    """A model that contradicts itself or another one."""


#: Hops that a relation may be followed again where nothing else is said.
DEFAULT_DEPTH = 3


@dataclass(frozen=True)
class Relation:
    name: str
    type: str
    model: str = ""
    fk: str = ""
    pk: str = ""
    through: str = ""
    where: str = ""
    through_where: str = ""
    order: str = ""
    reentrant: bool = False
    max_depth: int = 0
    polymorphic: bool = False
    type_column: str = ""
    table: str = ""

    @property
    def many(self) -> bool:
        """Whether a join over it may repeat rows."""
        return self.type != "belongs_to"


@dataclass(frozen=True)
class Field:
    source: str
    alias: str = ""
    type: str = ""
    preset: str = ""
    formatter: str = ""
    internal: bool = False
    localize: bool = False
    max_depth: int = 0

    @property
    def key(self) -> str:
        return self.alias or self.source


@dataclass(frozen=True)
class Preset:
    name: str
    fields: tuple[Field, ...] = ()
    extends: tuple[str, ...] = ()


@dataclass(frozen=True)
class Computable:
    source: str
    where: str = ""
    type: str = ""


@dataclass(frozen=True)
class Aggregatable:
    functions: tuple[str, ...]
    type: str = ""


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    relations: dict[str, Relation] = field(default_factory=dict)
    presets: dict[str, Preset] = field(default_factory=dict)
    computable: dict[str, Computable] = field(default_factory=dict)
    aggregatable: dict[str, Aggregatable] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    primary_keys: tuple[str, ...] = ("id",)


def snake(name: str) -> str:
    """``PersonProfile`` to ``person_profile``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
