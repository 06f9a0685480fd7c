"""An analytics request: the parts of a question, parsed and checked before planning."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from typing import Any

from halyard.plans.metrics import alias_of
from halyard.plans.timeframe import TimeFrame

MAX_BATCH = 25
CASTS = ("KPI", "TIMESERIES", "TABLE", "PIE", "BUBBLE", "CSV")
INTERVALS = ("minute", "hour", "day", "week", "month", "quarter", "year")
DEFAULT_LIMIT = 100


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class Metric:
    attribute: str = ""
    aggregation: str = "COUNT"
    name: str | None = None
    secondary: str | None = None
    filter: Any = None

    @property
    def alias(self) -> str:
        return alias_of(self.aggregation, self.attribute, self.name)


@dataclass(frozen=True)
class Dimension:
    attribute: str
    interval: str | None = None
    label_template: str | None = None

    @property
    def alias(self) -> str:
        return self.attribute.rsplit("/", 1)[-1]


@dataclass(frozen=True)
class Comparison:
    type: str
    label: str | None = None
    granularity: str | None = None
    amount: int = 1
    shortcut: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    value: float | None = None


@dataclass(frozen=True)
class Security:
    """What the caller may see. Scopes merge to the widest; NONE sees nothing."""

    tenant: Any = None
    user: Any = None
    scopes: tuple[str, ...] = ("ALL",)
    locations: tuple = ()
    reveal: bool = False


@dataclass(frozen=True)
class Request:
    entity: str
    metrics: tuple[Metric, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    filters: tuple = ()
    time_frame: TimeFrame = TimeFrame()
    comparisons: tuple[Comparison, ...] = ()
    measures: tuple[tuple[str, str], ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    cast: str | None = None
    limit: int | None = None
    cursor: str | None = None
    search: str | None = None
    select: Any = None
    hierarchy: dict | None = None
    fill_gaps: bool = False
    entity_id: Any = None
    as_of_tx: int | None = None

    @property
    def output(self) -> str:
        """The cast, told from the rest where it isn't given."""
        if self.cast:
            return self.cast.upper()
        if any(d.interval for d in self.dimensions):
            return "TIMESERIES"
        if self.metrics and not self.dimensions:
            return "KPI"
        return "TABLE"

    def page(self) -> tuple[int, int]:
        """(offset, limit); a cursor that can't be read is the first page."""
        limit = self.limit or (DEFAULT_LIMIT if self.output == "TABLE" and not self.metrics else 100_000)
        if self.cursor:
            try:
                offset, limit_text = base64.b64decode(self.cursor, validate=True).decode().split(":")
                if int(offset) >= 0 and int(limit_text) > 0:
                    return int(offset), int(limit_text)
            except ValueError:
                pass
        return 0, limit


def cursor_of(offset: int, limit: int) -> str:
    return base64.b64encode(f"{offset}:{limit}".encode()).decode()


@dataclass
class Page:
    """Where a page lies among all rows."""

    total: int
    offset: int
    limit: int
    next: str | None = field(init=False)
    previous: str | None = field(init=False)

    def __post_init__(self):
        self.next = cursor_of(self.offset + self.limit, self.limit) if self.has_next else None
        self.previous = cursor_of(max(self.offset - self.limit, 0), self.limit) if self.offset else None

    @property
    def has_next(self) -> bool:
        return self.offset + self.limit < self.total


def parse_request(data: dict) -> Request:
    """A request from its dict form, checked."""
    data = dict(data)
    if not data.get("entity"):
        raise RequestError("a request needs an entity")
    metrics = tuple(Metric(**m) for m in data.pop("metrics", ()))
    dimensions = tuple(Dimension(**d) if isinstance(d, dict) else Dimension(d) for d in data.pop("dimensions", ()))
    frame = data.pop("time_frame", None)
    out = Request(
        metrics=metrics, dimensions=dimensions, filters=tuple(data.pop("filters", ())),
        time_frame=TimeFrame(**frame) if isinstance(frame, dict) else frame or TimeFrame(),
        comparisons=tuple(Comparison(**c) for c in data.pop("comparisons", ())),
        measures=tuple((m["name"], m["formula"]) for m in data.pop("measures", ())),
        sort=tuple((s["field"], bool(s.get("descending"))) if isinstance(s, dict) else tuple(s) for s in data.pop("sort", ())), **data)
    check_request(out)
    return out


def check_request(r: Request) -> None:
    if r.output not in CASTS:
        raise RequestError(f"unknown output {r.output!r}")
    if r.output == "KPI" and not r.metrics:
        raise RequestError("a KPI needs a metric")
    for d in r.dimensions:
        if not d.attribute:
            raise RequestError("a dimension without an attribute")
        if d.interval and d.interval.lower() not in INTERVALS:
            raise RequestError(f"unknown interval {d.interval!r}")
    for m in r.metrics:
        if not m.attribute and m.aggregation.upper() != "COUNT":
            raise RequestError(f"{m.aggregation} needs an attribute")
    names = [d.alias for d in r.dimensions] + [m.alias for m in r.metrics]
    if len(set(names)) < len(names):
        raise RequestError(f"names repeat: {names}")
    if r.limit is not None and r.limit <= 0:
        raise RequestError("the limit must be above 0")


def parse_batch(queries: dict[str, dict], common_filters=(), cross_filters=(), entity: str | None = None) -> dict[str, Request]:
    """Requests by key; ``common_filters`` go before and ``cross_filters`` behind each one's own, a missing entity is inherited."""
    if len(queries) > MAX_BATCH:
        raise RequestError(f"{len(queries)} queries, {MAX_BATCH} at most")
    return {k: parse_request({**q, "entity": q.get("entity") or entity, "filters": [*common_filters, *q.get("filters", ()), *cross_filters]}) for k, q in queries.items()}
