import datetime as dt
from dataclasses import dataclass
from typing import Annotated
from uuid import UUID

import pytest

from fathom import annotated as A
from fathom.dsl import query
from fathom.engine import Coordinator, Engine
from fathom.errors import SchemaError
from fathom.schema import EntityType
from fathom.streaming.projection import Projection


@dataclass
class Author:
    """People who write."""

    Id: Annotated[str, A.Key]
    Name: Annotated[str | None, A.SearchKey(1), A.Metadata()] = None
    Articles: Annotated[list, A.HasMany("Article", "AuthorId")] = None


@dataclass
class Article:
    Id: Annotated[str, A.Key()]
    Title: Annotated[str, A.Embedded()]
    Body: Annotated[str | None, A.Passages(256, 32, True)] = None
    AuthorId: Annotated[UUID | None, A.RefersTo("Author", nest="Author")] = None
    TagIds: Annotated[list[str] | None, A.RefersTo("Tag")] = None
    At: Annotated[dt.datetime | None, A.Metadata] = None
    Words: int | None = None
    Summary: Annotated[str | None, A.Enriched("summary")] = None
    TenantId: Annotated[str | None, A.Tenant] = None
    OwnerId: Annotated[str | None, A.Owner] = None


def test_types_of_classes():
    t = A.entity_type(Article)
    assert (t.name, t.key, t.tenant_field, t.owner_field) == ("Article", "Id", "TenantId", "OwnerId")
    assert [(c.name, c.kind, c.array, c.nullable) for c in t.columns][:5] == [("Id", "string", False, False), ("Title", "string", False, False), ("Body", "string", False, True), ("AuthorId", "guid", False, True), ("TagIds", "string", True, True)]
    assert t.column("Body").chunk.max_tokens == 256 and t.column("Title").embedding and t.column("At").metadata and t.column("Summary").enrichment == "summary" and t.column("Words").kind == "int64"
    assert [(r.name, r.kind, r.target, r.key) for r in t.relations] == [("Author", "many_to_one", "Author", "AuthorId"), ("Tag", "many_to_many", "Tag", "TagIds")]
    own = A.entity_type(Author)
    assert own.relations[0].kind == "one_to_many" and own.column("Articles") is None and own.search_keys == ["Name"] and own.description == "People who write."


def test_rejected_classes():
    @dataclass
    class NoKey:
        Name: str

    @dataclass
    class Odd:
        Id: Annotated[str, A.Key]
        X: complex

    @dataclass
    class Two:
        Id: Annotated[str, A.Key]
        Other: Annotated[str, A.Key]

    for cls in (NoKey, Odd, Two):
        with pytest.raises(SchemaError):
            A.entity_type(cls)


def test_entities_are_instances(spark, tmp_path):
    own = Engine(spark).register(A.entity_type(Author))
    people = Coordinator(own, Author)
    key = people.persist(Author("", "Ada"))
    assert people.get(key) == Author(key, "Ada", None) and people.get("none") is None
    people.update(Author(key, "Ada L."))
    assert [a.Name for a in people.search(query("Author").build())] == ["Ada L."] and people.get_many([key])[0].Id == key
    t = EntityType("Author", "Id", A.entity_type(Author).columns)
    projected = Projection(spark, t, str(tmp_path / "p"))
    assert own.reconcile("Author", projected) == 1 and [r.Name for r in projected.read().collect()] == ["Ada L."]
    assert people.delete(key) and people.get(key) is None
    health = own.health()
    assert health["spark"] == health["log"] == health["columnar"] == "ok" and health["vectors"] == "not there"
