"""The ordered fold of an aggregate: (state, event) -> (new state, change or none), or an error.

One parent row and at most one child row make the aggregate's document. ``intended`` is the evident meaning; ``as_coded``
keeps known slips of the behaviour it follows: revisions restart at each copy of the state, child events are never
recognised as repeated, child updates report no differences, a child can't move to a known aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from foldwright.functions.backoff import RETRY, Backoff
from foldwright.functions.fieldmask import diff
from foldwright.sources.schema import DOCUMENT

INTENDED, AS_CODED = "intended", "as_coded"


class OutOfOrder(Exception):
    """The event can't be applied to the state yet."""


@dataclass(frozen=True)
class State:
    document: dict | None = None  # None: no aggregate
    last: dict = field(default_factory=dict)  # sequence numbers by source
    changed_at: int = 0
    revision: int = 0
    published: int = 0
    snapshot: dict | None = None  # document as last published


def dump(state: State) -> str:
    return json.dumps(state.__dict__)


def load(text: str | None) -> State:
    if not text:
        return State()
    d = json.loads(text)
    d["last"] = {k: tuple(tuple(x) for x in v) for k, v in d["last"].items()}
    return State(**d)


def cohesive(document: dict | None) -> bool:
    return bool(document and (document.get("vehicle_uuid") or "").strip() and document.get("engine"))


def fold(state: State, event: dict, mode: str = INTENDED) -> tuple[State, dict | None]:
    """event: aggregate, source (parent or child), op, lsn ((commit), (change)), ts_ms, before, after (documents)."""
    coded = mode == AS_CODED
    source, op, lsn = event["source"], event["op"], event["lsn"]
    if state.document is not None and not (coded and source == "child") and source in state.last and state.last[source] >= lsn:
        return state, None  # already applied, or overtaken
    if source == "parent" and op == "d":
        return _remove_parent(state, event, coded)
    new, kind, blank_mask = (_parent if source == "parent" else _child)(state.document, event, coded)
    copied = state.document is not None
    last = {} if coded and copied else state.last
    out = replace(
        state, document=new, last={**last, source: lsn}, changed_at=event["ts_ms"], revision=(0 if coded and copied else state.revision) + 1, published=0 if coded and copied else state.published
    )
    if not cohesive(new):
        return out, None
    out = replace(out, published=out.published + 1, snapshot=new)
    mask = [] if kind == "VehicleCreated" or blank_mask or (coded and source == "child" and op == "u") else diff(state.document, new, DOCUMENT)
    return out, _change(event, kind, out.published, None, mask, new, coded)


def _change(event: dict, kind: str, revision: int, parent_revision: int | None, mask: list[str], document: dict | None, coded: bool) -> dict:
    return {"entity_uuid": "" if coded else event["aggregate"], "changed_at_ms": event["ts_ms"], "event_type": kind, "revision_number": revision, "vehicle_revision_number": parent_revision, "field_mask": mask, "resulting_state": document}


def _parent(document: dict | None, event: dict, coded: bool) -> tuple[dict, str, bool]:
    if event["op"] == "u" and document is None:
        raise OutOfOrder("update of an unknown parent")
    after = event["after"]
    base = document or {"engine": None}
    new = {**base, "vehicle_uuid": base.get("vehicle_uuid") if event["op"] == "u" else after["vehicle_uuid"], "year_of_manufacture": after["year_of_manufacture"], "model": after["model"]}
    return new, "VehicleUpdated" if document is not None else "VehicleCreated", False


def _remove_parent(state: State, event: dict, coded: bool) -> tuple[State, dict | None]:
    if state.document is None:
        raise OutOfOrder("removal of an unknown parent")
    if state.document.get("engine"):
        raise OutOfOrder("removal of a parent before its child")
    change = _change(event, "VehicleDeleted", state.published + 1, state.published, [], None, coded) if state.snapshot is not None else None
    return State(), change


def _child(document: dict | None, event: dict, coded: bool) -> tuple[dict, str, bool]:
    op, before, after = event["op"], event["before"], event["after"]
    has = bool(document and document.get("engine"))
    if op in ("c", "r"):
        if has:
            raise OutOfOrder("second child")
        return _attached(document, after), "VehicleUpdated" if document is not None else "VehicleCreated", False
    if op == "d":
        if not has:
            raise OutOfOrder("removal of an unknown child")
        return {**document, "engine": None}, "VehicleUpdated", False
    old, new = before["vehicle_uuid"], after["vehicle_uuid"]
    if old == new:
        if not has:
            raise OutOfOrder("update of an unknown child")
        return {**document, "engine": after["engine"]}, "VehicleUpdated", False
    leaves = event["aggregate"] == old if not coded else document is not None
    if leaves:
        if not has:
            raise OutOfOrder("detaching an unknown child")
        return {**document, "engine": None}, "VehicleUpdated", False
    if document is not None and has:
        raise OutOfOrder("second child")
    if not (new or "").strip():
        raise OutOfOrder("detaching from an unknown parent")
    return _attached(document, after), "VehicleUpdated", document is None


def _attached(document: dict | None, after: dict) -> dict:
    base = document or {"year_of_manufacture": None, "model": None}
    return {**base, "vehicle_uuid": after["vehicle_uuid"], "engine": after["engine"]}


class Runner:
    """Applies one aggregate's events as they come, in order; from the first that fails on, all wait."""

    def __init__(self, mode: str = INTENDED, state: State | None = None) -> None:
        self.mode, self.state, self.stuck = mode, state or State(), False

    @staticmethod
    def waits(event: dict) -> dict:
        return {"aggregate": event["aggregate"], "item": event["item"], "status": "blocked", "error": None}

    def step(self, event: dict) -> dict:
        row = self.waits(event)
        if not self.stuck:
            try:
                self.state, change = fold(self.state, event, self.mode)
                row |= {"status": "processed", **(change or {})}
            except OutOfOrder as problem:
                row |= {"status": "failed", "error": str(problem)}
                self.stuck = True
        return row


def run(events: Iterable[dict], mode: str = INTENDED, state: State | None = None) -> tuple[State, list[dict]]:
    """A row for each event of one aggregate, which are sorted first, and the state after them."""
    runner = Runner(mode, state)
    rows = [runner.step(e) for e in sorted(events, key=lambda e: (e["lsn"], e["item"]))]
    return runner.state, rows


def next_retry(now_ms: int, failures: int, backoff: Backoff = RETRY) -> int:
    return now_ms + backoff.delay(failures)
