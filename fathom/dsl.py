"""Requests as data, and the fluent builders that make them. build() needs no session."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from .errors import QueryError
from .schema import IDENTIFIER

BASE = "base"


class Op(Enum):
    EQUALS = "eq"
    NOT_EQUALS = "neq"
    CONTAINS = "contains"
    STARTS_WITH = "starts_with"
    ENDS_WITH = "ends_with"
    GREATER_THAN = "gt"
    LESS_THAN = "lt"
    GREATER_THAN_OR_EQUALS = "gte"
    LESS_THAN_OR_EQUALS = "lte"
    IN = "in"
    VECTOR_SIMILAR = "vector_similar"


class Logic(Enum):
    AND = "and"
    OR = "or"


class JoinKind(Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"


class Agg(Enum):
    TERMS = "terms"
    DATE_HISTOGRAM = "date_histogram"
    RANGE = "range"
    AVG = "avg"
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    COUNT = "count"


class Window(Enum):
    ROW_NUMBER = "row_number"
    RANK = "rank"
    DENSE_RANK = "dense_rank"
    RUNNING_SUM = "running_sum"
    RUNNING_AVG = "running_avg"
    LAG = "lag"
    LEAD = "lead"


METRICS = {Agg.AVG, Agg.SUM, Agg.MIN, Agg.MAX, Agg.COUNT}
TRUNCATIONS = ("minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Clause:
    field: str
    op: Op
    value: Any
    negated: bool = False


@dataclass(frozen=True)
class Join:
    left_type: str
    left_field: str
    right_type: str
    right_field: str
    kind: JoinKind = JoinKind.INNER


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Metric:
    name: str
    type: Agg
    field: str | None = None
    expression: str | None = None


@dataclass(frozen=True)
class Bucket:
    key: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Spec:
    """One facet of an Aggregate request."""

    name: str
    type: Agg
    field: str | None = None
    expression: str | None = None
    size: int = 10
    interval: str = "month"
    time_zone: str = "UTC"
    buckets: tuple[Bucket, ...] = ()
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchRequest:
    type: str
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND
    joins: tuple[Join, ...] = ()
    sorts: tuple[Sort, ...] = ()
    fields: tuple[str, ...] = ()
    size: int = 20
    page: int = 0


@dataclass(frozen=True)
class GroupByRequest:
    type: str
    keys: tuple[str, ...]
    metrics: tuple[Metric, ...] = ()
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND
    having: tuple[Clause, ...] = ()
    having_logic: Logic = Logic.AND
    joins: tuple[Join, ...] = ()
    sorts: tuple[Sort, ...] = ()
    limit: int | None = 0  # 0: the default; None: all rows


@dataclass(frozen=True)
class AggregateRequest:
    type: str
    specs: tuple[Spec, ...]
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND
    having: tuple[Clause, ...] = ()
    having_logic: Logic = Logic.AND
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class WindowSpec:
    alias: str
    kind: Window
    order_by: str
    descending: bool = False
    field: str | None = None
    partition_by: str | None = None
    offset: int = 1


@dataclass(frozen=True)
class Pick:
    """One item of a projection: a column of a source, or all of them."""

    source: str
    column: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class StepJoin:
    source: str
    on: tuple[tuple[str, str], ...]
    kind: JoinKind = JoinKind.INNER


@dataclass(frozen=True)
class Step:
    name: str
    reads: str | None = None
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND
    windows: tuple[WindowSpec, ...] = ()
    keys: tuple[tuple[str, str | None], ...] = ()
    metrics: tuple[Metric, ...] = ()
    having: tuple[Clause, ...] = ()
    derive: tuple[tuple[str, str], ...] = ()
    joins: tuple[StepJoin, ...] = ()
    select: tuple[Pick, ...] = ()

    @property
    def aggregates(self) -> bool:
        return bool(self.keys or self.metrics or self.having)


@dataclass(frozen=True)
class PipelineRequest:
    type: str
    steps: tuple[Step, ...]
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND
    sorts: tuple[Sort, ...] = ()
    limit: int | None = 0  # 0: the default; None: all rows


@dataclass(frozen=True)
class SimilarRequest:
    type: str
    property: str
    text: str
    top_k: int = 10
    clauses: tuple[Clause, ...] = ()
    logic: Logic = Logic.AND


@dataclass(frozen=True)
class ChunksRequest:
    type: str
    property: str
    text: str
    top_k: int = 10
    clauses: tuple[Clause, ...] = ()


class _Filtered:
    """Clauses with where/not_ and a logic."""

    def __init__(self) -> None:
        self._clauses: list[Clause] = []
        self._logic = Logic.AND

    def where(self, field: str, op: Op, value: Any):
        self._clauses.append(Clause(field, op, value))
        return self

    def not_(self, field: str, op: Op, value: Any):
        self._clauses.append(Clause(field, op, value, negated=True))
        return self

    def with_logic(self, logic: Logic):
        self._logic = logic
        return self


class _Having(_Filtered):
    def __init__(self) -> None:
        super().__init__()
        self._having: list[Clause] = []
        self._having_logic = Logic.AND
        self._joins: list[Join] = []

    def having(self, alias: str, op: Op, value: Any):
        self._having.append(Clause(alias, op, value))
        return self

    def with_having_logic(self, logic: Logic):
        self._having_logic = logic
        return self

    def join(self, left_field: str, right_type: str, right_field: str, kind: JoinKind = JoinKind.INNER, left_type: str | None = None):
        self._joins.append(Join(left_type or self._type, left_field, right_type, right_field, kind))
        return self


class _Metrics:
    """sum, avg, min, max, count and their forms over expressions; default alias {field}_{function}."""

    _metrics: list[Metric]

    def _metric(self, kind: Agg, field: str | None, alias: str | None, expression: str | None = None):
        self._metrics.append(Metric(alias or f"{field}_{kind.value}", kind, field, expression))
        return self

    def sum(self, field: str, alias: str | None = None):
        return self._metric(Agg.SUM, field, alias)

    def avg(self, field: str, alias: str | None = None):
        return self._metric(Agg.AVG, field, alias)

    def min(self, field: str, alias: str | None = None):
        return self._metric(Agg.MIN, field, alias)

    def max(self, field: str, alias: str | None = None):
        return self._metric(Agg.MAX, field, alias)

    def count(self, field: str, alias: str | None = None):
        return self._metric(Agg.COUNT, field, alias)

    def count_all(self, alias: str = "count"):
        return self._metric(Agg.COUNT, None, alias)

    def sum_expr(self, expression: str, alias: str):
        return self._metric(Agg.SUM, None, alias, expression)

    def avg_expr(self, expression: str, alias: str):
        return self._metric(Agg.AVG, None, alias, expression)

    def min_expr(self, expression: str, alias: str):
        return self._metric(Agg.MIN, None, alias, expression)

    def max_expr(self, expression: str, alias: str):
        return self._metric(Agg.MAX, None, alias, expression)


class FieldCondition:
    """What where(field) and must_not(field) return: one operator completes the clause."""

    def __init__(self, builder: QueryBuilder, field: str, negated: bool = False) -> None:
        self._builder, self._field, self._negated = builder, field, negated

    def _add(self, op: Op, value: Any) -> QueryBuilder:
        self._builder._clauses.append(Clause(self._field, op, value, self._negated))
        return self._builder

    def eq(self, value):
        return self._add(Op.EQUALS, value)

    def neq(self, value):
        return self._add(Op.NOT_EQUALS, value)

    def gt(self, value):
        return self._add(Op.GREATER_THAN, value)

    def gte(self, value):
        return self._add(Op.GREATER_THAN_OR_EQUALS, value)

    def lt(self, value):
        return self._add(Op.LESS_THAN, value)

    def lte(self, value):
        return self._add(Op.LESS_THAN_OR_EQUALS, value)

    def contains(self, value: str):
        return self._add(Op.CONTAINS, value)

    def starts_with(self, value: str):
        return self._add(Op.STARTS_WITH, value)

    def ends_with(self, value: str):
        return self._add(Op.ENDS_WITH, value)

    def in_(self, values: Sequence[str]):
        return self._add(Op.IN, list(values))


class QueryBuilder:
    """A filtered, sorted and paged search."""

    def __init__(self, type_name: str) -> None:
        self._type = type_name
        self._clauses: list[Clause] = []
        self._logic = Logic.AND
        self._joins: list[Join] = []
        self._sorts: list[Sort] = []
        self._fields: tuple[str, ...] = ()
        self._size, self._page = 20, 0
        self._specs: list[Spec] = []

    def where(self, field: str) -> FieldCondition:
        return FieldCondition(self, field)

    def must_not(self, field: str) -> FieldCondition:
        return FieldCondition(self, field, negated=True)

    def fields(self, *names: str) -> QueryBuilder:
        self._fields = names
        return self

    def join(self, left_field: str, right_type: str, right_field: str, kind: JoinKind = JoinKind.INNER) -> QueryBuilder:
        return self.join_from(self._type, left_field, right_type, right_field, kind)

    def join_from(self, left_type: str, left_field: str, right_type: str, right_field: str, kind: JoinKind = JoinKind.INNER) -> QueryBuilder:
        self._joins.append(Join(left_type, left_field, right_type, right_field, kind))
        return self

    def order_by(self, field: str, descending: bool = False) -> QueryBuilder:
        self._sorts.append(Sort(field, descending))
        return self

    def order_by_desc(self, field: str) -> QueryBuilder:
        return self.order_by(field, True)

    def limit(self, n: int) -> QueryBuilder:
        self._size = n
        return self

    def offset(self, page: int) -> QueryBuilder:
        self._page = page
        return self

    def with_logic(self, logic: Logic) -> QueryBuilder:
        self._logic = logic
        return self

    def facet(self, kind: Agg, field: str, **more) -> QueryBuilder:
        """A facet named {field}_{kind}, for build_aggregate()."""
        self._specs.append(Spec(f"{field}_{kind.value}", kind, field, **more))
        return self

    def build(self) -> SearchRequest:
        if self._specs:
            raise QueryError("this query has facets; use build_aggregate()")
        return SearchRequest(self._type, tuple(self._clauses), self._logic, tuple(self._joins), tuple(self._sorts), tuple(self._fields), self._size, self._page)

    def build_aggregate(self) -> AggregateRequest:
        if self._sorts or self._page or self._size != 20:
            raise QueryError("sorting and paging have no meaning for facets")
        return AggregateRequest(self._type, tuple(self._specs), tuple(self._clauses), self._logic, joins=tuple(self._joins))


class GroupByBuilder(_Having, _Metrics):
    def __init__(self, type_name: str) -> None:
        super().__init__()
        self._type = type_name
        self._keys: list[str] = []
        self._metrics = []
        self._sorts: list[Sort] = []
        self._limit: int | None = 0

    def key(self, field: str) -> GroupByBuilder:
        self._keys.append(field)
        return self

    def keys(self, *fields: str) -> GroupByBuilder:
        self._keys += fields
        return self

    def order_by(self, field: str, descending: bool = False) -> GroupByBuilder:
        self._sorts.append(Sort(field, descending))
        return self

    def order_by_desc(self, field: str) -> GroupByBuilder:
        return self.order_by(field, True)

    def limit(self, n: int) -> GroupByBuilder:
        self._limit = n
        return self

    def all_rows(self) -> GroupByBuilder:
        """Every row, however many; without this or a limit the default limit holds."""
        self._limit = None
        return self

    def build(self) -> GroupByRequest:
        outputs = [k.rpartition(".")[2].lower() for k in self._keys] + [m.name.lower() for m in self._metrics]
        if not self._keys:
            raise QueryError("group_by needs one key at least")
        if len(set(outputs)) != len(outputs):
            raise QueryError("two outputs have one name")
        for name in [h.field for h in self._having]:
            if name.rpartition(".")[2].lower() not in outputs:
                raise QueryError(f"'{name}' is neither a key nor a metric of this query")
        return GroupByRequest(self._type, tuple(self._keys), tuple(self._metrics), tuple(self._clauses), self._logic, tuple(self._having), self._having_logic, tuple(self._joins), tuple(self._sorts), self._limit)


class AggregateBuilder(_Having):
    def __init__(self, type_name: str) -> None:
        super().__init__()
        self._type = type_name
        self._specs: list[Spec] = []

    def _spec(self, spec: Spec) -> AggregateBuilder:
        if spec.name.lower() in {s.name.lower() for s in self._specs}:
            raise QueryError(f"two aggregations are named '{spec.name}'")
        self._specs.append(spec)
        return self

    def terms(self, field: str, name: str, size: int = 10) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.TERMS, field, size=size))

    def terms_of(self, fields: Sequence[str], name: str, size: int = 10) -> AggregateBuilder:
        """Terms over several fields at once; the bucket key joins their values with |."""
        return self._spec(Spec(name, Agg.TERMS, fields[0], size=size, group_by=tuple(fields)))

    def date_histogram(self, field: str, name: str, calendar_interval: str = "month", time_zone: str = "UTC") -> AggregateBuilder:
        return self._spec(Spec(name, Agg.DATE_HISTOGRAM, field, interval=calendar_interval, time_zone=time_zone))

    def range(self, field: str, name: str, buckets: Sequence[tuple[str, float | None, float | None]]) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.RANGE, field, buckets=tuple(Bucket(*b) for b in buckets)))

    def avg(self, field: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.AVG, field))

    def sum(self, field: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.SUM, field))

    def min(self, field: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.MIN, field))

    def max(self, field: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.MAX, field))

    def count(self, field: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, Agg.COUNT, field))

    def count_all(self, name: str = "count") -> AggregateBuilder:
        return self._spec(Spec(name, Agg.COUNT))

    def metric_expr(self, kind: Agg, expression: str, name: str) -> AggregateBuilder:
        return self._spec(Spec(name, kind, expression=expression))

    def build(self) -> AggregateRequest:
        if not self._specs:
            raise QueryError("one aggregation at least is required")
        return AggregateRequest(self._type, tuple(self._specs), tuple(self._clauses), self._logic, tuple(self._having), self._having_logic, tuple(self._joins))


class SelectBuilder:
    def __init__(self) -> None:
        self.picks: list[Pick] = []

    def all_from(self, source: str) -> SelectBuilder:
        self.picks.append(Pick(source))
        return self

    def pick(self, source: str, column: str, alias: str | None = None) -> SelectBuilder:
        self.picks.append(Pick(source, column, alias))
        return self


class StepBuilder(_Filtered, _Metrics):
    """One step of a pipeline; what cannot share a step is rejected at once."""

    def __init__(self, name: str, earlier: list[str]) -> None:
        super().__init__()
        self._name, self._earlier = name, earlier
        self._reads: str | None = None
        self._windows: list[WindowSpec] = []
        self._keys: list[tuple[str, str | None]] = []
        self._metrics = []
        self._having: list[Clause] = []
        self._derive: list[tuple[str, str]] = []
        self._joins: list[StepJoin] = []
        self._select: list[Pick] = []

    def reads(self, step_name: str) -> StepBuilder:
        if step_name.lower() not in {e.lower() for e in self._earlier}:
            raise QueryError(f"step '{self._name}' reads '{step_name}', which is not an earlier step")
        self._reads = step_name
        return self

    def _window(self, alias, kind, field, order_by, descending, partition_by, offset=1) -> StepBuilder:
        self._windows.append(WindowSpec(alias, kind, order_by, descending, field, partition_by, offset))
        return self

    def row_number(self, alias: str, *, order_by: str, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.ROW_NUMBER, None, order_by, descending, partition_by)

    def rank(self, alias: str, *, order_by: str, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.RANK, None, order_by, descending, partition_by)

    def dense_rank(self, alias: str, *, order_by: str, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.DENSE_RANK, None, order_by, descending, partition_by)

    def running_sum(self, alias: str, field: str, *, order_by: str, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.RUNNING_SUM, field, order_by, descending, partition_by)

    def running_avg(self, alias: str, field: str, *, order_by: str, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.RUNNING_AVG, field, order_by, descending, partition_by)

    def lag(self, alias: str, field: str, *, order_by: str, offset: int = 1, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.LAG, field, order_by, descending, partition_by, offset)

    def lead(self, alias: str, field: str, *, order_by: str, offset: int = 1, descending: bool = False, partition_by: str | None = None) -> StepBuilder:
        return self._window(alias, Window.LEAD, field, order_by, descending, partition_by, offset)

    def group_by(self, field: str, date_trunc: str | None = None) -> StepBuilder:
        self._keys.append((field, date_trunc))
        return self

    def having(self, alias: str, op: Op, value: Any) -> StepBuilder:
        self._having.append(Clause(alias, op, value))
        return self

    def derive(self, alias: str, expr: str) -> StepBuilder:
        self._derive.append((alias, expr))
        return self

    def join(self, source: str, on_left: str, on_right: str, kind: JoinKind = JoinKind.INNER) -> StepBuilder:
        return self.join_all(source, [(on_left, on_right)], kind)

    def join_all(self, source: str, on: Sequence[tuple[str, str]], kind: JoinKind = JoinKind.INNER) -> StepBuilder:
        self._joins.append(StepJoin(source, tuple(on), kind))
        return self

    def select(self, configure: Callable[[SelectBuilder], object]) -> StepBuilder:
        own = SelectBuilder()
        configure(own)
        self._select += own.picks
        return self

    def build_step(self) -> Step:
        step = Step(self._name, self._reads, tuple(self._clauses), self._logic, tuple(self._windows), tuple(self._keys), tuple(self._metrics), tuple(self._having), tuple(self._derive), tuple(self._joins), tuple(self._select))
        if step.windows and step.aggregates:
            raise QueryError(f"step '{step.name}': windows and grouping cannot share a step")
        if step.aggregates and not step.keys:
            raise QueryError(f"step '{step.name}': metrics need a key")
        if step.joins and not step.select:
            raise QueryError(f"step '{step.name}': joins need a select")
        names = [w.alias.lower() for w in step.windows] + [m.name.lower() for m in step.metrics] + [a.lower() for a, _ in step.derive]
        if len(set(names)) != len(names):
            raise QueryError(f"step '{step.name}': two outputs have one name")
        return step


class PipelineBuilder(_Filtered):
    def __init__(self, type_name: str) -> None:
        super().__init__()
        self._type = type_name
        self._steps: list[Step] = []
        self._sorts: list[Sort] = []
        self._limit: int | None = 0

    def step(self, name: str, configure: Callable[[StepBuilder], object]) -> PipelineBuilder:
        earlier = [BASE, *(s.name for s in self._steps)]
        if not IDENTIFIER.match(name or ""):
            raise QueryError(f"'{name}' is not a valid step name")
        if name.lower() in {e.lower() for e in earlier}:
            raise QueryError(f"'{name}' is taken by an earlier step")
        own = StepBuilder(name, earlier)
        configure(own)
        self._steps.append(own.build_step())
        return self

    def sort_on(self, field: str, descending: bool = False) -> PipelineBuilder:
        self._sorts.append(Sort(field, descending))
        return self

    def sort_on_desc(self, field: str) -> PipelineBuilder:
        return self.sort_on(field, True)

    def limit(self, n: int) -> PipelineBuilder:
        self._limit = n
        return self

    def all_rows(self) -> PipelineBuilder:
        """Every row, however many; without this or a limit the default limit holds."""
        self._limit = None
        return self

    def build(self) -> PipelineRequest:
        if not self._steps:
            raise QueryError("a pipeline needs one step at least")
        return PipelineRequest(self._type, tuple(self._steps), tuple(self._clauses), self._logic, tuple(self._sorts), self._limit)


class SimilarBuilder(_Filtered):
    def __init__(self, type_name: str, property: str) -> None:
        super().__init__()
        self._type, self._property, self._text, self._top_k = type_name, property, "", 10

    def where(self, field: str, op: Op, value: Any):
        if op in (Op.CONTAINS, Op.STARTS_WITH, Op.ENDS_WITH):
            raise QueryError(f"{op.name} is not supported in vector searches")
        return super().where(field, op, value)

    def text(self, query: str) -> SimilarBuilder:
        self._text = query
        return self

    def top_k(self, top_k: int) -> SimilarBuilder:
        self._top_k = top_k
        return self

    def build(self) -> SimilarRequest:
        return SimilarRequest(self._type, self._property, self._text, self._top_k, tuple(self._clauses), self._logic)


class ChunksBuilder:
    def __init__(self, type_name: str, property: str) -> None:
        self._type, self._property, self._text, self._top_k = type_name, property, "", 10
        self._clauses: list[Clause] = []

    def text(self, query: str) -> ChunksBuilder:
        self._text = query
        return self

    def top_k(self, top_k: int) -> ChunksBuilder:
        self._top_k = top_k
        return self

    def where(self, field: str, op: Op, value: Any) -> ChunksBuilder:
        if op is not Op.EQUALS:
            raise QueryError("passage searches filter by EQUALS only")
        self._clauses.append(Clause(field, op, value))
        return self

    def build(self) -> ChunksRequest:
        return ChunksRequest(self._type, self._property, self._text, self._top_k, tuple(self._clauses))


def query(type_name: str) -> QueryBuilder:
    return QueryBuilder(type_name)


def group_by(type_name: str) -> GroupByBuilder:
    return GroupByBuilder(type_name)


def aggregate(type_name: str) -> AggregateBuilder:
    return AggregateBuilder(type_name)


def pipeline(type_name: str) -> PipelineBuilder:
    return PipelineBuilder(type_name)


def similar(type_name: str, property: str) -> SimilarBuilder:
    return SimilarBuilder(type_name, property)


def chunks(type_name: str, property: str) -> ChunksBuilder:
    return ChunksBuilder(type_name, property)
