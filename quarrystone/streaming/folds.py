"""Stateful operators as folds over the ordered rows of a key.

A fold has a first state and a step from state and row to the next state and
some output rows. It runs over a stream, its state kept by Structured
Streaming, or over a table: sorted by key and order within each partition and
read in one pass, so that a key of any size needs no more memory than its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

Row = dict[str, Any]


@dataclass
class Fold:
    """``state`` must be JSON; ``step`` returns output rows and changes it in place."""

    schema: str
    step: Callable[[dict, Row], list[Row]]
    start: dict = field(default_factory=dict)

    def fresh(self) -> dict:
        return json.loads(json.dumps(self.start))


def fold_table(rows: DataFrame, key: str, order: Sequence[str], fold: Fold) -> DataFrame:
    """The fold over a table."""
    schema = to_arrow_schema(_struct(rows, fold.schema))
    key_at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for batch in batches:
            out: list[Row] = []
            keys = batch.column(key_at).to_pylist()
            for own, row in zip(keys, batch.to_pylist(), strict=True):
                if own != now:
                    now, state = own, fold.fresh()
                out += fold.step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, fold.schema)


def _struct(rows: DataFrame, schema: str) -> StructType:
    return rows.sparkSession.createDataFrame([], schema).schema


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, order: Sequence[str], columns: Sequence[str]):
        self.fold, self.order, self.columns = fold, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timer_values):
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else self.fold.fresh()
        out: list[Row] = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records"):
            out += self.fold.step(state, row)
        self.kept.update((json.dumps(state, default=str),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, order: Sequence[str], fold: Fold) -> DataFrame:
    """The fold over a stream; rows of one micro-batch are taken in order. Needs the RocksDB state store."""
    columns = [f.name for f in _struct(rows, fold.schema).fields]
    return rows.groupBy(key).transformWithStateInPandas(_Processor(fold, order, columns), fold.schema, "append", "none")


# ---------------------------------------------------------------- admission


def rate_limit(limit: int, seconds: int) -> Fold:
    """key, at (microseconds): admitted while fewer than ``limit`` were admitted in the last ``seconds``."""

    def step(state: dict, row: Row) -> list[Row]:
        recent = [t for t in state["admitted"] if row["at"] - t <= seconds * 1_000_000]
        ok = len(recent) < limit
        state["admitted"] = [*recent, row["at"]] if ok else recent
        return [{"key": row["key"], "seq": row["seq"], "admitted": ok}]

    return Fold("key long, seq long, admitted boolean", step, {"admitted": []})


def login_throttle(attempts: int = 10, seconds: int = 60, failures: int = 5, locked: int = 900) -> Fold:
    """key, seq, at, ok: each attempt as throttled, locked, failed or passed; a success clears the failures."""

    def step(state: dict, row: Row) -> list[Row]:
        second = 1_000_000
        at = row["at"]
        state["tries"] = [t for t in state["tries"] if at - t < seconds * second]
        if at < state["until"]:
            outcome = "locked"
        elif len(state["tries"]) >= attempts:
            outcome = "throttled"
        else:
            state["tries"].append(at)
            outcome = "passed" if row["ok"] else "failed"
            state["failed"] = 0 if row["ok"] else state["failed"] + 1
            if state["failed"] >= failures:
                state["until"], state["failed"] = at + locked * second, 0
        return [{"key": row["key"], "seq": row["seq"], "outcome": outcome}]

    return Fold("key long, seq long, outcome string", step, {"tries": [], "failed": 0, "until": 0})


def circuit_breaker(failures: int = 3, seconds: int = 60) -> Fold:
    """key, seq, at, ok: closed until ``failures`` in a row, then open for ``seconds``; calls while open are not made."""

    def step(state: dict, row: Row) -> list[Row]:
        is_open = row["at"] < state["until"]
        if not is_open:
            state["failed"] = 0 if row["ok"] else state["failed"] + 1
            if state["failed"] >= failures:
                state["until"], state["failed"] = row["at"] + seconds * 1_000_000, 0
        return [{"key": row["key"], "seq": row["seq"], "open": is_open}]

    return Fold("key long, seq long, open boolean", step, {"failed": 0, "until": 0})


def quota() -> Fold:
    """Two-phase quota of one model: all counters of a reservation, or none.

    Rows: key (the model), seq, op (reserve, release, reconcile), reservation,
    counters (name and limit each; no limit, no counter) and amount. A live
    reservation's repeat answers as the first did; a release or a reconcile
    counts once, and a reconciled one is not released.
    """

    def step(state: dict, row: Row) -> list[Row]:
        used, held = state["used"], state["held"]
        own = held.get(row["reservation"])
        denied = None
        if row["op"] == "reserve":
            if own is None or own["status"] == "released":
                counters = {c["name"]: c["limit"] for c in row["counters"] or [] if c["limit"]}
                denied = next((n for n, most in counters.items() if used.get(n, 0) + row["amount"] > most), None)
                if denied is None:
                    own = held[row["reservation"]] = {"names": list(counters), "amount": row["amount"], "status": "held"}
                    _add(used, own["names"], row["amount"])
        elif own and own["status"] == "held":
            change = -own["amount"] if row["op"] == "release" else row["amount"] - own["amount"]
            _add(used, own["names"], change)
            own["status"] = {"release": "released", "reconcile": "settled"}[row["op"]]
            own["amount"] += change
        amount = own["amount"] if own and denied is None else 0
        return [{"key": row["key"], "seq": row["seq"], "allowed": denied is None, "denied_by": denied, "amount": amount, "used": sum(used.values())}]

    return Fold("key string, seq long, allowed boolean, denied_by string, amount long, used long", step, {"used": {}, "held": {}})


def _add(used: dict, names: Sequence[str], amount: int) -> None:
    for name in names:
        used[name] = max(0, used.get(name, 0) + amount)


# ---------------------------------------------------------------- memory


def replay(seconds: int = 900) -> Fold:
    """key (the request), seq, at, hash: first, replay (same hash within the time) or conflict (another hash)."""

    def step(state: dict, row: Row) -> list[Row]:
        if not state or row["at"] - state["at"] > seconds * 1_000_000:
            state.update(at=row["at"], hash=row["hash"])
            outcome = "first"
        else:
            outcome = "replay" if row["hash"] == state["hash"] else "conflict"
        return [{"key": row["key"], "seq": row["seq"], "outcome": outcome}]

    return Fold("key string, seq long, outcome string", step)


def ttl_cache(seconds: int = 1800) -> Fold:
    """key (the question), seq, at: a hit within ``seconds`` of the row that filled the cache, else a fill."""

    def step(state: dict, row: Row) -> list[Row]:
        hit = bool(state) and row["at"] - state["at"] <= seconds * 1_000_000
        if not hit:
            state["at"] = row["at"]
        return [{"key": row["key"], "seq": row["seq"], "hit": hit}]

    return Fold("key string, seq long, hit boolean", step)


# ---------------------------------------------------------------- token streams

#: Signs that end a segment.
SEGMENT_ENDS = "。！？!?；;\n"


def segments(longest: int = 96, held: int = 24) -> Fold:
    """key (the stream), seq, piece, done: pieces to segments that end at a sign; a long rest goes but for its tail."""

    def step(state: dict, row: Row) -> list[Row]:
        text = state["rest"] + (row["piece"] or "")
        out, start = [], 0
        for i, c in enumerate(text):
            if c in SEGMENT_ENDS:
                out.append(text[start : i + 1])
                start = i + 1
        rest = text[start:]
        if len(rest) > longest:
            out.append(rest[:-held])
            rest = rest[-held:]
        if row["done"] and rest:
            out.append(rest)
            rest = ""
        state["rest"] = rest
        made = [{"key": row["key"], "seq": row["seq"], "part": state["n"] + i, "segment": s} for i, s in enumerate(out)]
        state["n"] += len(out)
        return made

    return Fold("key string, seq long, part long, segment string", step, {"rest": "", "n": 0})


def hidden_spans(opening: str = "<think>", closing: str = "</think>") -> Fold:
    """key, seq, piece, done: what lies between the tags goes, wherever pieces cut a tag."""

    def tail(text: str, *tags: str) -> int:
        most = 0
        for tag in tags:
            # A tag that is cut at the end begins at one of its first characters there.
            at = text.find(tag[0], max(0, len(text) - len(tag) + 1))
            while at >= 0 and not tag.startswith(text[at:]):
                at = text.find(tag[0], at + 1)
            most = max(most, len(text) - at if at >= 0 else 0)
        return most

    def step(state: dict, row: Row) -> list[Row]:
        text, shown = state["rest"] + (row["piece"] or ""), ""
        while True:
            tag = closing if state["inside"] else opening
            before, found, after = text.partition(tag)
            if not found:
                break
            shown += "" if state["inside"] else before
            state["inside"], text = not state["inside"], after
        kept = tail(text, closing) if state["inside"] else tail(text, opening, closing)
        shown += "" if state["inside"] else text[: len(text) - kept]
        state["rest"] = "" if row["done"] else text[len(text) - kept :]
        return [{"key": row["key"], "seq": row["seq"], "shown": shown}] if shown else []

    return Fold("key string, seq long, shown string", step, {"rest": "", "inside": False})


def deltas() -> Fold:
    """key, seq, piece: snapshots that grow, to what each adds; one that does not continue the last starts anew."""

    def step(state: dict, row: Row) -> list[Row]:
        now, seen = row["piece"] or "", state["seen"]
        new = now[len(seen) :] if now.startswith(seen) else now
        state["seen"] = now
        return [{"key": row["key"], "seq": row["seq"], "delta": new}] if new else []

    return Fold("key string, seq long, delta string", step, {"seen": ""})


def guarded(pattern: str, rewrite: str, margin: int = 64) -> Fold:
    """key, seq, segment: segments pass until the text so far matches; then the rewrite, and no more.

    The state is not the text but its tail from where a match may still come
    about (a partial match that reaches the end, or the last ``margin``
    characters), and ``margin`` characters before it for what looks back. So
    it is bounded by the longest stretch that the pattern can leave open. A
    condition on more than ``margin`` characters behind, or on what follows
    the text's end beyond it, is not seen.
    """
    bad = regex.compile(pattern)

    def step(state: dict, row: Row) -> list[Row]:
        if state["over"]:
            return []
        segment = row["segment"] or ""
        text, begin = state["tail"] + segment, state["from"]
        if bad.search(text, begin):
            state["over"] = True
            mark = "" if not state["tail"] or state["tail"][-1] in SEGMENT_ENDS + "." else "\n\n"
            return [{"key": row["key"], "seq": row["seq"], "shown": mark + rewrite}]
        may = bad.search(text, begin, partial=True)
        begin = max(begin, min(may.start() if may else len(text), len(text) - margin))
        cut = max(0, begin - margin)
        state.update(tail=text[cut:], **{"from": begin - cut})
        return [{"key": row["key"], "seq": row["seq"], "shown": segment}]

    return Fold("key string, seq long, shown string", step, {"tail": "", "from": 0, "over": False})
