"""A stateful processor whose answers do not hang on how a stream is cut into batches."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Open events of a key that lie in its snapshot; more of them are moved to chunks of the map, of so many events at most.
INLINE, CHUNK = 100, 10_000
EPOCH = datetime(1970, 1, 1)


def _plain(value):
    """Times without a zone, in UTC, however they arrive."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


class OrderedProcessor(StatefulProcessor):
    """Folds a key's events in the order of ``seq``, whatever the order in which they arrive.

    The state holds a snapshot of the fold and the events it rests on. Every call of the state costs far more than folding an
    event, so a key and batch take one read and one write: few open events lie in the snapshot, many in chunks of
    a map, and of the times that a key waits for only the earliest has a timer, which stays when it moves back and
    looks again when it fires. Events behind all known ones go on from the snapshot. When one arrives late, the key is folded anew, and
    the rows whose answer has changed are given out again. ``known``, the last column of every row, is
    the number of events it rests on: of rows with the same seq those with the largest count.

    With ``seal`` the watermark bounds the state: events that it has passed can have no new predecessors, so
    they are folded into a sealed base and leave the map, at the next event or by a timer; folding anew starts from
    the base. That takes ``seq`` to rise with time: an event that is in time but numbered before sealed ones is
    folded right behind them. ``forget_ms`` clears keys that have been still for so long in event time.

    Subclasses name ``EVENT`` (the columns kept, seq first, as DDL), ``OUT`` (columns given out,
    without ``known``; ``seq`` is one of them), ``start`` and ``fold``, and may name a ``deadline``.
    """

    EVENT = ""
    OUT: tuple[str, ...] = ()

    def __init__(self, ttl_ms: int | None = None, seal: bool = False, forget_ms: int | None = None):
        self.ttl_ms, self.seal, self.forget_ms = ttl_ms, seal, forget_ms

    def start(self):
        """State before any event."""
        raise NotImplementedError

    def fold(self, key, state, event) -> tuple[object, list[tuple]]:
        """State after an event, and the rows that the event gives."""
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        """Time in ms at which the watermark makes ``expired`` rows of a state."""
        return None

    def expired(self, key, state) -> list[tuple]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "chunk bigint", "events binary", self.ttl_ms)
        self.snapshot = handle.getValueState("snapshot", "held binary", self.ttl_ms)
        self.row = Row(*self.OUT, "known")

    @staticmethod
    def order(event: tuple) -> tuple:
        """Events with one seq follow by their other values, so that ties do not hang on arrival."""
        return (event[0], *[(v is not None, str(v)) for v in event[1:]])

    def _folded(self, key, state, events: list[tuple]) -> tuple[object, dict[tuple, list[tuple]]]:
        """State and rows after events (with their times as last values) in order."""
        out: dict[tuple, list[tuple]] = {}
        for order, e in sorted(((self.order(e[:-1]), e) for e in events), key=itemgetter(0)):
            state, rows = self.fold(key, state, e[:-1])
            out.setdefault(order, []).extend(rows)
        return state, out

    def _arrived(self, rows: Iterator[Row]) -> list[tuple]:
        names, places, new = [c.split()[0] for c in self.EVENT.split(", ")] + ["event_ms"], None, []
        for r in rows:
            places = places or [r.__fields__.index(n) for n in names]
            new.append(tuple(_plain(r[i]) for i in places))
        return new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = self._arrived(rows)
        if not new:
            return
        at = self._load()
        out = self._judged(key, at, new, timerValues.getCurrentWatermarkInMs() if self.seal else None)
        self._keep(key, at)
        for r in out:
            yield self.row(*r, at["known"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = self._load()
        out, forget = self._fired(key, at, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if forget:
            self.open.clear()
            self.snapshot.clear()
        else:
            self._keep(key, at)
        for r in out:
            yield self.row(*r, at["known"])

    def _judged(self, key, at: dict, new: list[tuple], watermark: int | None) -> list[tuple]:
        """Take new events of a key into its state: the rows that they give or change."""
        if at["sealed"] is not None:
            # Numbered before sealed events: right behind them.
            new = [(max(e[0], at["sealed"] + 1), *e[1:]) for e in new]
        if at["last"] is None or min(e[0] for e in new) > at["last"]:
            at["state"], after = self._folded(key, at["state"], new)
            out = [r for found in after.values() for r in found]
        else:
            old = self._held(key, at)
            _, before = self._folded(key, at["base"], old)
            at["state"], after = self._folded(key, at["base"], [*old, *new])
            out = [r for order, found in after.items() if before.get(order) != found for r in found]
        at["held"] += new
        at["known"] += len(new)
        at["last"] = max([e[0] for e in new] + ([] if at["last"] is None else [at["last"]]))
        if self.seal:
            times = [e[-1] for e in new if e[-1] is not None]
            at["least"] = min([t for t in [at["least"], *times] if t is not None], default=None)
            at["latest"] = max([t for t in [at["latest"], *times] if t is not None], default=None)
            self._sealed(key, at, watermark)
            self._timer(at)
        return out

    def _fired(self, key, at: dict, now: int, timer: int) -> tuple[list[tuple], bool]:
        """What a key's timer gives, and whether the key is to be forgotten."""
        at["timer"] = None
        due = self.deadline(at["state"])
        out = []
        if due is not None and due <= max(now, timer) and due != at["announced"]:
            at["announced"] = due
            out = self.expired(key, at["state"])
        forget = self.forget_ms is not None and at["latest"] is not None and at["latest"] + self.forget_ms <= now
        if not forget:
            self._sealed(key, at, now)
            self._timer(at)
        return out, forget

    def _held(self, key, at: dict) -> list[tuple]:
        """All open events of a key."""
        return [e for (chunk,) in (self._chunks(key, at) if at["chunks"] else ()) for e in pickle.loads(bytes(chunk))] + at["held"]

    def _sealed(self, key, at: dict, watermark: int) -> None:
        """Fold the first open events that the watermark has passed into the base. Events without a time wait for nobody."""
        if at["least"] is None or at["least"] > watermark:
            return
        held = sorted(self._held(key, at), key=lambda e: self.order(e[:-1]))
        done = next((i for i, e in enumerate(held) if e[-1] is not None and e[-1] > watermark), len(held))
        if done:
            at["base"], _ = self._folded(key, at["base"], held[:done])
            at["sealed"] = held[done - 1][0]
            if at["chunks"]:
                self._drop_chunks(key, at)
            at["held"], at["chunks"] = held[done:], 0
        at["least"] = min((e[-1] for e in held[done:] if e[-1] is not None), default=None)

    def _timer(self, at: dict) -> None:
        """Have a timer no later than the first time that the state waits for."""
        due = self.deadline(at["state"])
        wanted = [due] if due is not None and due != at["announced"] else []
        if at["least"] is not None:
            wanted.append(at["latest"])
        if self.forget_ms is not None and at["latest"] is not None:
            wanted.append(at["latest"] + self.forget_ms)
        if wanted and (at["timer"] is None or min(wanted) < at["timer"]):
            self._wait(at["timer"], min(wanted))
            at["timer"] = min(wanted)

    def _wait(self, old: int | None, due: int) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)

    def _load(self) -> dict:
        held = self.snapshot.get()
        return self._unknown() if held is None else pickle.loads(bytes(held[0]))

    def _unknown(self) -> dict:
        return {"last": None, "known": 0, "state": self.start(), "sealed": None, "base": self.start(), "held": [], "chunks": 0,
                "least": None, "latest": None, "announced": None, "timer": None}

    def _keep(self, key, at: dict) -> None:
        self._cut(key, at)
        self.snapshot.update((pickle.dumps(at),))

    def _cut(self, key, at: dict) -> None:
        """Move many open events to chunks."""
        if len(at["held"]) > INLINE:
            for i in range(0, len(at["held"]), CHUNK):
                self._add_chunk(key, at, pickle.dumps(at["held"][i:i + CHUNK]))
                at["chunks"] += 1
            at["held"] = []

    def _chunks(self, key, at: dict) -> Iterator[tuple]:
        return self.open.values()

    def _add_chunk(self, key, at: dict, events: bytes) -> None:
        self.open.updateValue((at["chunks"],), (events,))

    def _drop_chunks(self, key, at: dict) -> None:
        self.open.clear()

    def close(self) -> None:
        pass


class Buckets(OrderedProcessor):
    """Mixin that keeps many keys in one state, for streams with few events per key and batch.

    Grouping by key costs several calls for each key of a batch, which take far longer than to fold an event. Here
    keys lie in a fixed number of buckets; a bucket and batch take one read, one write and at most two timer calls, and of its keys only those
    with events or a timer that is due are unpacked. Answers are those of a state per key. Every key keeps its own
    snapshot, timer and chunks; the bucket's timer is its keys' earliest. There is no ``ttl_ms``, as stillness would be the bucket's.

    Rows come as one JSON text each (``packed``) in pandas tables and leave in those, since Spark hands others over value by value. ``EVENT`` may
    have whole numbers, texts and times; ``KEY`` names the key, a text.
    """

    KEY = ""

    @classmethod
    def packed(cls) -> Column:
        """A row as JSON: its key, the columns of ``EVENT`` in order, its time in ms; times in microseconds."""
        fields = [f.split() for f in cls.EVENT.split(", ")]
        values = [(F.unix_micros(n) if kind == "timestamp" else F.col(n)).alias(f"v{i}") for i, (n, kind) in enumerate(fields)]
        return F.to_json(F.struct(F.col(cls.KEY).alias("k"), *values, F.col("event_ms").alias(f"v{len(fields)}")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "name string, chunk bigint", "events binary")
        self.bucket = handle.getValueState("bucket", "held binary")
        self.names = list(self._unknown())
        kinds = [f.split()[1] for f in self.EVENT.split(", ")]
        self.values, self.times = [f"v{i}" for i in range(len(kinds) + 1)], [f"v{i}" for i, kind in enumerate(kinds) if kind == "timestamp"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for table in rows:
            for r in json.loads(f"[{','.join(table['row'])}]"):
                for n in self.times:
                    if n in r:
                        r[n] = EPOCH + timedelta(microseconds=r[n])
                new.setdefault(r.get("k"), []).append(tuple(map(r.get, self.values)))
        if not new:
            return
        held, timer = self._load()
        watermark, out = timerValues.getCurrentWatermarkInMs() if self.seal else None, []
        for name, events in new.items():
            at = self._unpacked(held.get(name))
            out += [(*r, at["known"]) for r in self._judged((name,), at, events, watermark)]
            held[name] = self._packed((name,), at)
        self._keep(held, timer)
        yield from self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        (held, timer), out = self._load(), []
        for name, (due, packed) in list(held.items()):
            if due is None or due > max(now, fired):
                continue
            at = self._unpacked((due, packed))
            rows, forget = self._fired((name,), at, now, fired)
            out += [(*r, at["known"]) for r in rows]
            if forget:
                self._drop_chunks((name,), at)
                del held[name]
            else:
                held[name] = self._packed((name,), at)
        self._keep(held, None if timer == fired else timer)
        yield from self._table(out)

    def _table(self, rows: list[tuple]) -> list[pd.DataFrame]:
        return [pd.DataFrame(rows, columns=[*self.OUT, "known"], dtype=object)] if rows else []

    def _unpacked(self, held: tuple | None) -> dict:
        return self._unknown() if held is None else dict(zip(self.names, pickle.loads(held[1])))

    def _packed(self, key, at: dict) -> tuple[int | None, bytes]:
        self._cut(key, at)
        return at["timer"], pickle.dumps(tuple(at.values()))

    def _load(self) -> tuple[dict, int | None]:
        """(timer and snapshot by key, the bucket's timer)."""
        held = self.bucket.get()
        return ({}, None) if held is None else pickle.loads(bytes(held[0]))

    def _keep(self, held: dict, timer: int | None) -> None:
        due = min((t for t, _ in held.values() if t is not None), default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if held or timer is not None:
            self.bucket.update((pickle.dumps((held, timer)),))
        else:
            self.bucket.clear()

    def _wait(self, old: int | None, due: int) -> None:
        """The bucket's timer is set when all its keys are done."""

    def _chunks(self, key, at: dict) -> Iterator[tuple]:
        return (self.open.getValue((key[0], i)) for i in range(at["chunks"]))

    def _add_chunk(self, key, at: dict, events: bytes) -> None:
        self.open.updateValue((key[0], at["chunks"]), (events,))

    def _drop_chunks(self, key, at: dict) -> None:
        for i in range(at["chunks"]):
            self.open.removeKey((key[0], i))


def run_ordered(events: DataFrame, key: str, processor: Callable[..., OrderedProcessor], out: str, ttl_ms: int | None = None,
                delay: str | None = None, forget_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """Fold a stream by key. With ``delay`` the events need ``ts``, and the watermark seals what is older; without it the state
    keeps every event until ``ttl_ms`` of stillness. ``buckets`` is for processors that are ``Buckets``: their number, which stays as it is with a checkpoint."""
    if delay is None:
        if forget_ms is not None:
            raise ValueError("forget_ms needs a delay")
        events, mode = events.withColumn("event_ms", F.lit(None).cast("bigint")), "none" if ttl_ms is None else "processingtime"
    else:
        if ttl_ms is not None:
            raise ValueError("with a delay keys are forgotten by forget_ms")
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_ms", F.unix_millis("ts")).withWatermark("ts", delay)
        mode = "eventtime"
    made, out = processor(ttl_ms=ttl_ms, seal=delay is not None, forget_ms=forget_ms), f"{out}, known bigint"
    if buckets is None:
        return events.groupBy(key).transformWithState(statefulProcessor=made, outputStructType=out, outputMode="append", timeMode=mode)
    if ttl_ms is not None:
        raise ValueError("buckets have no ttl_ms")
    dealt = events.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), made.packed().alias("row"), *(["ts"] if delay is not None else []))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=made, outputStructType=out, outputMode="append", timeMode=mode)


def settled(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of a stream's output table that stand: per ``by`` those that rest on the most events."""
    best = rows.groupBy(*by).agg(F.max("known").alias("_known"))
    same = [rows[c].eqNullSafe(best[c]) for c in by]
    condition = rows["known"] == best["_known"]
    for s in same:
        condition = condition & s
    return rows.join(best, condition, "left_semi").drop("known")
