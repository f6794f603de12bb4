"""Entity types from annotated dataclasses of an application, and entities as their instances.

    @dataclass
    class Article:
        Id: Annotated[str, Key()]
        Title: Annotated[str, Embedded()]
        Body: Annotated[str | None, Passages(256, 32)] = None
        AuthorId: Annotated[UUID | None, RefersTo("Author", nest="Author")] = None
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import types
import typing
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from .errors import SchemaError
from .schema import Chunking, Column, EntityType, Relation


@dataclass(frozen=True)
class Key:
    """The entity's key."""


@dataclass(frozen=True)
class Tenant:
    """The tenant that a row belongs to."""


@dataclass(frozen=True)
class Owner:
    """The user that a row belongs to."""


@dataclass(frozen=True)
class SearchKey:
    """A column that tables are sorted by."""

    order: int = 0


@dataclass(frozen=True)
class Large:
    """A long text that is no search key."""


@dataclass(frozen=True)
class Metadata:
    """A column that passages carry."""


@dataclass(frozen=True)
class Embedded:
    """A text with a vector."""


@dataclass(frozen=True)
class Passages:
    """A text that is cut into passages with vectors."""

    max_tokens: int = 512
    overlap: int = 64
    contextual: bool = False


@dataclass(frozen=True)
class Enriched:
    """A text that a model fills: a summary, keywords, or what the hint asks for."""

    kind: str = "summary"
    hint: str = ""


@dataclass(frozen=True)
class RefersTo:
    """A key of another type, or a list of them; nest: the name under which that entity is read along."""

    target: str
    nest: str = ""
    kind: str = ""


@dataclass(frozen=True)
class HasMany:
    """Entities of another type whose column `key` holds this one's key; not a column here."""

    target: str
    key: str


# The kinds of Python's types.
KINDS = {str: "string", uuid.UUID: "guid", int: "int64", float: "double", bool: "bool", dt.datetime: "datetime", bytes: "bytes"}


def _plain(hint) -> tuple[type, bool, bool, tuple]:
    """(type, whether it is a list, whether it may be None, marks) of an annotation."""
    marks: tuple = ()
    if typing.get_origin(hint) is typing.Annotated:
        hint, *extra = typing.get_args(hint)
        marks = tuple(m() if isinstance(m, type) else m for m in extra)
    nullable = False
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(hint) if a is not type(None)]
        nullable = len(inner) < len(typing.get_args(hint))
        if len(inner) != 1:
            raise SchemaError(f"{hint} is not one type")
        hint = inner[0]
    array = typing.get_origin(hint) in (list, tuple)
    return (typing.get_args(hint)[0] if array else hint), array, nullable, marks


def entity_type(cls: type, name: str = "", **more) -> EntityType:
    """The entity type of an annotated dataclass."""
    key, roles, columns, relations = "", {}, [], []
    hints = typing.get_type_hints(cls, include_extras=True)
    for f in dataclasses.fields(cls):
        kind, array, nullable, marks = _plain(hints[f.name])
        by = {type(m): m for m in marks}
        if HasMany in by:
            relations.append(Relation(f.name, "one_to_many", by[HasMany].target, by[HasMany].key))
            continue
        if kind not in KINDS:
            raise SchemaError(f"{cls.__name__}.{f.name}: {kind} has no column type")
        if Key in by:
            if key:
                raise SchemaError(f"{cls.__name__} has two keys")
            key = f.name
        roles |= {role: f.name for mark, role in ((Tenant, "tenant_field"), (Owner, "owner_field")) if mark in by}
        if ref := by.get(RefersTo):
            own = ref.nest or f.name.removesuffix("Ids").removesuffix("Id")
            relations.append(Relation(own, ref.kind or ("many_to_many" if array else "many_to_one"), ref.target, f.name))
        chunk, enriched, search = by.get(Passages), by.get(Enriched), by.get(SearchKey)
        columns.append(
            Column(
                f.name, KINDS[kind], array, nullable and Key not in by, search.order if search else None, Large in by, Metadata in by, Embedded in by,
                Chunking(chunk.max_tokens, chunk.overlap, chunk.contextual) if chunk else None, enriched.kind if enriched else None, enriched.hint if enriched else "",
            )
        )
    if not key:
        raise SchemaError(f"{cls.__name__} has no key")
    return EntityType(name or cls.__name__, key, tuple(columns), tuple(relations), **roles, description=(cls.__doc__ or "").strip().split("\n")[0], **more)


def maker(cls: type) -> Callable[[dict], object]:
    """A function that makes instances from rows; what a class does not name is left out, what a row lacks is None."""
    names = {f.name.lower(): f.name for f in dataclasses.fields(cls)}

    def make(row: dict):
        found = {names[k.lower()]: v for k, v in row.items() if k.lower() in names}
        return cls(**{n: found.get(n) for n in names.values()})

    return make


def row_of(entity) -> dict:
    """An instance as a row: without what is read along from other types."""
    hints = typing.get_type_hints(type(entity), include_extras=True)
    kept = [f.name for f in dataclasses.fields(entity) if not any(isinstance(m, HasMany) or m is HasMany for m in _plain(hints[f.name])[3])]
    return {n: str(v) if isinstance(v := getattr(entity, n), uuid.UUID) else v for n in kept}
