"""The engine: requests in, frames out; writes in, events out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import annotated, authz, dsl, session
from .errors import DeniedError, PreconditionError, QueryError, UnavailableError
from .operators import facets, grouping, pipeline, retrieval, search, similarity, writes
from .operators.relational import Context
from .schema import EntityType, Registry, migrate
from .streaming import projection
from .streaming.outbox import Log
from .tenants import Tenants


@dataclass
class Engine:
    """Types, their rows, and what callers may do. Without rules there is no authorization."""

    spark: SparkSession
    registry: Registry = field(default_factory=Registry)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    rules: dict[str, authz.Rules] | None = None
    vectors: similarity.VectorStore | None = None
    columnar: bool = True
    log: Log | None = None
    tenants: Tenants | None = None
    produce: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        session.configure(self.spark)
        self.log = self.log or Log(self.spark)
        self.bases = dict(self.frames)
        for name in self.frames:
            self._refresh(name)

    def register(self, t: EntityType, rows: DataFrame | None = None) -> Engine:
        """Declare a type, or declare it anew: stored rows take its shape."""
        self.registry.register(t)
        name = t.name.lower()
        if rows is not None:
            self.bases[name] = rows
        elif name in self.bases:
            self.bases[name] = migrate(self.bases[name], t)
        else:
            self.bases[name] = self.spark.createDataFrame([], t.spark_schema())
        self._refresh(name)
        return self

    def _refresh(self, name: str) -> None:
        """The rows that a type began with, and over them what the log says: a plan of one size, however many writes there were."""
        base, t = self.bases[name], self.registry.get(name)
        written = self.log.path is not None or any(e[1].lower() == name for e in self.log.held)
        self.frames[name] = projection.merge(base, self.log.events(), _stored(t, base), projection.RECORDS) if t is not None and written else base

    def _limits(self, caller: authz.Caller | None) -> dict | None:
        if self.rules is None:
            return None
        if caller is not None and (caller.suspended or (self.tenants is not None and not self.tenants.active(caller.tenant))):
            raise DeniedError("the tenant is unknown, suspended or deleted")
        return {t.name.lower(): authz.evaluate(t, self.rules.get(t.name.lower()), caller) for t in self.registry}

    def context(self, caller: authz.Caller | None = None) -> Context:
        return Context(self.registry, self.frames, self._limits(caller))

    def _columnar(self, caller: authz.Caller | None) -> Context:
        if not self.columnar:
            raise PreconditionError("the columnar store is switched off")
        return self.context(caller)

    def search(self, request: dsl.SearchRequest, caller: authz.Caller | None = None) -> DataFrame:
        return search.search(self._columnar(caller), request)

    def group_by(self, request: dsl.GroupByRequest, caller: authz.Caller | None = None) -> DataFrame:
        return grouping.group_by(self._columnar(caller), request)

    def aggregate(self, request: dsl.AggregateRequest, caller: authz.Caller | None = None) -> DataFrame:
        return facets.aggregate(self._columnar(caller), request)

    def total(self, request: dsl.AggregateRequest, caller: authz.Caller | None = None) -> int:
        return facets.total(self._columnar(caller), request)

    def pipeline(self, request: dsl.PipelineRequest, caller: authz.Caller | None = None) -> DataFrame:
        return pipeline.pipeline(self._columnar(caller), request)

    def get(self, type_name: str, key, caller: authz.Caller | None = None, depth: int = 0) -> DataFrame:
        """The entity of a key, or no row; a type that is not registered has none."""
        ctx = self.context(caller)
        if ctx.registry.get(type_name) is None:
            return self.spark.createDataFrame([], "key string")
        rows = retrieval.get(ctx, type_name, key)
        return retrieval.with_relations(ctx, type_name, rows, depth) if depth > 0 else rows

    def get_many(self, type_name: str, keys: Sequence, caller: authz.Caller | None = None) -> DataFrame:
        return retrieval.get_many(self.context(caller), type_name, keys)

    def related(self, type_name: str, depth: int = 1, caller: authz.Caller | None = None) -> DataFrame:
        return retrieval.with_relations(self.context(caller), type_name, depth=depth)

    def health(self) -> dict[str, str]:
        """`ok`, or what is wrong, of each part that requests need."""
        checks = {
            "spark": lambda: self.spark.range(1).count(), "log": lambda: self.log.events().limit(1).count(),
            "columnar": lambda: None if self.columnar else "switched off", "vectors": lambda: None if self.vectors is not None else "not there",
        }
        out = {}
        for name, check in checks.items():
            try:
                found = check()
                out[name] = found if isinstance(found, str) else "ok"
            except Exception as e:
                out[name] = f"{type(e).__name__}: {e}"[:200]
        return out

    def reconcile(self, type_name: str, projected: projection.Projection) -> int:
        """Project every row of a type anew; how many."""
        t = self.context().type(type_name)
        rows = self.frames[t.name.lower()]
        projected.apply(projection.reconcile(rows, t, above=max(projected.top_offset(), 0)))
        return rows.count()

    def _vectors(self) -> similarity.VectorStore:
        if self.vectors is None:
            raise UnavailableError("there is no vector store")
        return self.vectors

    def similar(self, request: dsl.SimilarRequest, caller: authz.Caller | None = None, now=None) -> DataFrame:
        ctx = self.context(caller)
        return similarity.similar(ctx, self._vectors(), ctx.type(request.type), request.property, request.text, request.top_k, request.clauses, request.logic, now)

    def chunks(self, request: dsl.ChunksRequest, caller: authz.Caller | None = None) -> DataFrame:
        ctx = self.context(caller)
        return similarity.passages(ctx, self._vectors(), ctx.type(request.type), request.property, request.text, request.top_k, request.clauses)

    def persist(self, type_name: str, row: dict, caller: authz.Caller | None = None, make_key: bool = False, update: bool = False) -> str:
        """Write one entity and give its key; make_key ignores a key that the row brings. Columns that the row lacks become null."""
        t = self.context(caller).type(type_name)
        writes.validate_relations(t, row)
        stored = None
        if update:
            if not row.get(t.key):
                raise QueryError("an update needs a key")
            found = retrieval.get(Context(self.registry, self.frames), type_name, row[t.key]).first()
            stored = found.asDict() if found else None
        if self.rules is not None:
            row = authz.prepare_write(t, self.rules.get(t.name.lower()), caller, row, stored, make_key)
        elif make_key or not row.get(t.key):
            row = row | {t.key: authz.new_key()}
        names = {n.lower(): n for n in t.names}
        clean = {names[k.lower()]: v for k, v in row.items() if k.lower() in names and not isinstance(v, dict)}
        schema = self.bases[t.name.lower()].schema
        change = self.spark.createDataFrame([tuple(clean.get(f.name) for f in schema)], schema)
        payload = change.select(F.to_json(F.struct("*"))).first()[0]
        self._write("updated" if update else "created", t, str(row[t.key]), payload)
        return row[t.key]

    def delete(self, type_name: str, key, caller: authz.Caller | None = None) -> bool:
        """Delete the entity of a key if the caller may see it; the event holds what it was."""
        ctx = self.context(caller)
        t = ctx.type(type_name)
        gone = retrieval.get(ctx, type_name, key).select(F.col(f"`{t.key}`").cast("string").alias("key")).first()
        if gone is None:
            return False
        whole = self.frames[t.name.lower()].where(F.col(f"`{t.key}`").cast("string") == gone.key)
        self._write("deleted", t, gone.key, whole.select(F.to_json(F.struct("*"))).first()[0])
        return True

    def _write(self, op: str, t: EntityType, key: str, payload: str) -> None:
        """One append to the log, then a first try to publish it; what fails is left to the log's poller."""
        targets = projection.RECORDS | projection.COLUMNAR * t.columnar | projection.VECTOR * t.vectorised | projection.ENRICHMENT * any(c.enrichment for c in t.columns)
        self.log.append(op, t.name, [(key, payload)], targets, dt.datetime.now(dt.timezone.utc))
        self._refresh(t.name.lower())
        if self.produce is not None:
            self.log.publish(self.produce)


def _stored(t: EntityType, base: DataFrame) -> EntityType:
    """The type with the columns of its rows, as the log's payloads have them; every tenant's rows count here."""
    return EntityType.of_frame(t.name, t.key, base)


class Coordinator:
    """One type's entities for an application: as dicts, or as instances of an annotated dataclass."""

    def __init__(self, engine: Engine, type_name: str | type, caller: authz.Caller | None = None, make: Callable[[dict], object] = dict) -> None:
        self.engine, self.caller = engine, caller
        own = isinstance(type_name, type)
        self.type = type_name.__name__ if own else type_name
        self.make = annotated.maker(type_name) if own else make

    def persist(self, row) -> str:
        return self.engine.persist(self.type, self._row(row), self.caller)

    def update(self, row) -> None:
        self.engine.persist(self.type, self._row(row), self.caller, update=True)

    @staticmethod
    def _row(row) -> dict:
        return row if isinstance(row, dict) else annotated.row_of(row)

    def delete(self, key) -> bool:
        return self.engine.delete(self.type, key, self.caller)

    def get(self, key):
        row = self.engine.get(self.type, key, self.caller).first()
        return None if row is None else self.make(row.asDict(recursive=True))

    def get_many(self, keys: Sequence) -> list:
        rows = self.engine.get_many(self.type, keys, self.caller).where("found").drop("position", "requested_key", "found").collect()
        return [self.make(r.asDict(recursive=True)) for r in rows]

    def search(self, request: dsl.SearchRequest) -> list:
        return [self.make(r.asDict(recursive=True)) for r in self.engine.search(request, self.caller).collect()]
