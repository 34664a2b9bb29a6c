"""The seams at which a backend can be put in, as protocols; the DataFrame classes of this package satisfy them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class EventLog(Protocol):
    def load_from(self, after: int, limit: int) -> DataFrame: ...

    def load_stream(self, aggregate_type: str, aggregate_id, after_version: int | None = None) -> DataFrame: ...

    def latest_position(self) -> int: ...

    def append(self, new: DataFrame, order: str) -> int: ...


class PointerStore(Protocol):
    def position(self): ...

    def save(self, position: int) -> None: ...

    def stage(self, position: int) -> None: ...

    def promote(self) -> None: ...


class ReactorQueue(Protocol):
    def enqueue(self, batch: str, commits: DataFrame) -> None: ...

    def pending(self) -> DataFrame: ...

    def resolve(self, batch: str, results: DataFrame) -> int: ...

    def checkpoint(self) -> int: ...


class TailSource(Protocol):
    def stream(self) -> DataFrame: ...

    def trigger(self) -> dict: ...


class InspectorReadModel(Protocol):
    def list_events(self, limit: int, **filters) -> DataFrame: ...

    def get_event(self, position: int) -> DataFrame: ...

    def lineage_tree(self, position: int) -> DataFrame: ...

    def lineage_flow(self, correlation_id: str) -> DataFrame: ...

    def events_from(self, start: int, limit: int) -> DataFrame: ...

    def reactor_logs(self, event_id, reactor_id: str) -> DataFrame: ...

    def reactor_logs_by_correlation(self, correlation_id: str) -> DataFrame: ...

    def reactor_outcomes(self, correlation_id: str) -> DataFrame: ...

    def reactor_descriptions(self, correlation_id: str) -> DataFrame: ...

    def reactor_description_snapshots(self, correlation_id: str) -> DataFrame: ...

    def aggregate_state_timeline(self, correlation_id: str) -> DataFrame: ...

    def list_correlations(self, search: str | None, limit: int) -> DataFrame: ...

    def reactor_dependencies(self) -> DataFrame: ...

    def aggregate_lifecycle(self, key: str, limit: int = 100) -> DataFrame: ...

    def list_aggregate_keys(self) -> DataFrame: ...
