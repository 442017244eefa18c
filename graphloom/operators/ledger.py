"""Process only what is new since the last success: a ledger of work items.

An item is pending, leased or done. Leases expire; every lease of an item has a higher fencing token
than the one before, and only the holder of the highest may finish the item. What an item yields is
written under a path that follows from the item alone, so a repeated attempt replaces, never adds.

Two forms of one ledger: ``WorkLedger`` keeps the events of items in a shared folder and runs work
against them; ``lease_events`` / ``ranges`` take the events from a table of attempts over ranges of a
log (one row per attempt) and fold them in Spark, and ``outstanding`` looks records up in the items.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Ranges, as they are looked up, are sent to all executors up to so many rows (some MB); above, both sides are shuffled.
BROADCAST_RANGES = 50_000
#: An attempt without an outcome holds its lease for so many seconds.
TTL = 600.0


class StaleLease(RuntimeError):
    """The item was leased again, or finished, since this lease began."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int
    owner: str
    expires: float
    payload: dict


class WorkLedger:
    """Items under ``<path>/items/<item>/<number>.json``: event files, each created once and never changed.

    The state of an item is the fold of its events. Creating the next number is the atomic step:
    of two writers one fails and reads again. ``clock`` gives seconds and can be replaced in tests.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = 600.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.ttl, self.clock = spark, path.rstrip("/"), ttl, clock
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._done: set[str] = set()  # done is final, so such items are not read again

    def _append(self, item: str, number: int, event: dict) -> bool:
        p = self.Path(f"{self.path}/items/{item}/{number:09d}.json")
        if self.fs.exists(p):
            return False
        try:
            out = self.fs.create(p, False)  # fails if another writer was first
        except Exception:
            return False
        out.write(bytearray(json.dumps(event).encode()))
        out.close()
        return True

    def _events(self, item: str) -> list[dict]:
        d = self.Path(f"{self.path}/items/{item}")
        if not self.fs.exists(d):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(d) if s.getPath().getName().endswith(".json"))
        return [self._event(f"{self.path}/items/{item}/{n}") for n in names]

    def _event(self, path: str) -> dict:
        """An event; one whose writer died before it was whole says nothing but takes its number."""
        try:
            return json.loads(self._read(path))
        except ValueError:
            return {}

    def _read(self, path: str) -> str:
        stream = self.fs.open(self.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def add(self, item: str, payload: dict | None = None) -> bool:
        """Enter an item; entering it again changes nothing."""
        if not re.fullmatch(r"[\w.-]+", item):
            raise ValueError(f"not a name for an item: {item!r}")
        p = self.Path(f"{self.path}/payload/{item}.json")
        if self.fs.exists(self.Path(f"{self.path}/items/{item}/{0:09d}.json")):
            return False
        # first what the item means, then that it exists: a writer that dies in between leaves no item
        out = self.fs.create(p, True)
        out.write(bytearray(json.dumps(payload or {}).encode()))
        out.close()
        return self._append(item, 0, {"kind": "added", "at": self.clock()})

    def items(self) -> list[str]:
        d = self.Path(f"{self.path}/items")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(d)) if self.fs.exists(d) else []

    def payload(self, item: str) -> dict:
        return json.loads(self._read(f"{self.path}/payload/{item}.json"))

    def state(self, item: str) -> tuple[str, int]:
        """``(pending | leased | done, highest token so far)``; a lease that has expired is pending again."""
        return self._fold(self._events(item))

    def _fold(self, events: list[dict]) -> tuple[str, int]:
        state, token, expires = "pending", 0, 0.0
        for e in events:
            if e.get("kind") == "leased":
                state, token, expires = "leased", e["token"], e["expires"]
            elif e.get("kind") == "released" and e["token"] == token:
                state = "pending"
            elif e.get("kind") == "done" and e["token"] == token:
                state = "done"
        return ("pending" if state == "leased" and expires <= self.clock() else state), token

    def lease(self, owner: str, item: str | None = None) -> Lease | None:
        """Lease one pending item, or None if there is none."""
        for name in [item] if item else self.items():
            if name in self._done:
                continue
            events = self._events(name)
            state, token = self._fold(events)
            if state == "done":
                self._done.add(name)
            if state == "pending" and events:
                now = self.clock()
                e = {"kind": "leased", "token": token + 1, "owner": owner, "at": now, "expires": now + self.ttl}
                if self._append(name, len(events), e):
                    return Lease(name, token + 1, owner, now + self.ttl, self.payload(name))
        return None

    def output(self, item: str) -> str:
        """Where the item's rows go, whoever writes them."""
        return f"{self.path}/out/{item}"

    def finish(self, lease: Lease, rows: DataFrame | None = None) -> None:
        """Write ``rows`` and mark the item done; StaleLease if a later lease exists or the item is done."""
        staged = f"{self.path}/staged/{lease.item}-{lease.token}"
        if rows is not None:
            rows.write.mode("overwrite").parquet(staged)
        while True:
            events = self._events(lease.item)
            state, token = self._fold(events)
            if token != lease.token or state == "done":
                self.fs.delete(self.Path(staged), True)
                raise StaleLease(f"{lease.item}: token {lease.token} was followed by {token} ({state})")
            if self._append(lease.item, len(events), {"kind": "done", "token": lease.token, "at": self.clock()}):
                break
        self.publish(lease.item)

    def publish(self, item: str) -> None:
        """Move what the finishing token staged to its place; can be repeated after a crash in between."""
        state, token = self.state(item)
        staged, out = self.Path(f"{self.path}/staged/{item}-{token}"), self.Path(self.output(item))
        if state == "done" and self.fs.exists(staged) and not self.fs.exists(out):
            self.fs.mkdirs(out.getParent())
            self.fs.rename(staged, out)

    def release(self, lease: Lease) -> None:
        events = self._events(lease.item)
        if self._fold(events)[1] == lease.token:
            self._append(lease.item, len(events), {"kind": "released", "token": lease.token, "at": self.clock()})

    def run(self, owner: str, work: Callable[[Lease], DataFrame]) -> int:
        """Lease and do items until none is pending; a failing item is released and raises."""
        for name in self.items():
            self.publish(name)
        n = 0
        while lease := self.lease(owner):
            try:
                self.finish(lease, work(lease))
            except StaleLease:
                continue
            except Exception:
                self.release(lease)
                raise
            n += 1
        return n


def deliverable(log: DataFrame) -> DataFrame:
    """Committed records of ``log``, one row each, with ``commit_lsn`` and ``arrived_at`` for ``advance``.

    A record can be processed once it and its CommitTxn are there, so the later of their first arrivals
    counts, and its place on the axis is its ``commit_lsn``.
    """
    from ..sources.log import committed

    records = log.filter("op not in ('BeginTxn', 'CommitTxn')").groupBy("lsn", "txn_id").agg(F.min("arrived_at").alias("first"))
    commits = log.filter("op = 'CommitTxn'").groupBy("txn_id").agg(F.min("arrived_at").alias("closed"))
    return committed(records, log).join(commits, "txn_id").select("lsn", "txn_id", "commit_lsn", F.when(F.col("first").isNotNull() & F.col("closed").isNotNull(), F.greatest("first", "closed")).alias("arrived_at"))


def advance(ledger: WorkLedger, source: DataFrame, key: str = "lsn", step: int = 100_000, arrived: str = "arrived_at") -> int:
    """Enter items for what ``source`` holds and no item covers yet. Returns their number.

    Each item covers the rows with ``from < key <= to`` and, if ``source`` has the column ``arrived``,
    ``after < arrived <= until`` in microseconds (``after`` null: from the beginning); ``part`` selects
    them. Above the highest range entered so far new ranges are entered, and for rows that came later
    into a range entered before, done or not, a follow-up item. So every row belongs to one item, and
    an item's rows stay the same for every attempt.

    ``source`` has one row per record, with its first arrival; what comes later arrives after what was
    there. Without the column a row below the highest range can't be told from an old one, and ``source``
    must come in ascending order of ``key``.
    """
    timed = arrived in source.columns
    src = source.select(F.col(key).alias("key"), (_micros(arrived) if timed else F.lit(None).cast("long")).alias("at")).filter("key is not null")
    lo, hi, until, unknown = src.agg(F.min("key"), F.max("key"), F.max("at"), F.count(F.when(F.col("at").isNull(), 1))).first()
    if hi is None:
        return 0
    if timed and unknown:
        raise ValueError(f"{unknown} rows have no {arrived}: what came late can't be told")
    entered: dict[tuple[int, int], int | None] = {}
    for p in (ledger.payload(i) for i in ledger.items() if i.startswith(f"{key}-")):
        r, u = (p["from"], p["to"]), p.get("until")
        entered[r] = u if entered.get(r) is None else max(u or entered[r], entered[r])
    n = 0
    if timed and entered:
        if None in entered.values():
            raise ValueError(f"ranges were entered without {arrived}: what came late can't be told")
        # one range lies below all: keys beneath the lowest range belong to none so far
        bottom = min(f for f, _ in entered)
        for f, t, u in _late(src, sorted((f, t, u) for (f, t), u in entered.items())):
            n += ledger.add(f"{key}-{_digits(f)}-{_digits(t)}-{_digits(until)}", {"from": f, "to": t, "after": u, "until": until})
        if lo <= bottom:
            n += ledger.add(f"{key}-{_digits(lo - 1)}-{_digits(bottom)}", {"from": lo - 1, "to": bottom, "after": None, "until": until})
    at = max((t for _, t in entered), default=lo - 1)
    while at < hi:
        to = min(at + step, hi)
        bounds = {"after": None, "until": until} if timed else {}
        n += ledger.add(f"{key}-{_digits(at)}-{_digits(to)}", {"from": at, "to": to, **bounds})
        at = to
    return n


def _late(src: DataFrame, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The ranges (from, to, until), disjoint and ascending, with rows (key, at) later than ``until``; each row is looked up by bisection."""
    lows, highs, untils = (np.array(x, np.int64) for x in zip(*known, strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            i = np.minimum(np.searchsorted(highs, k), len(highs) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(i[(k > lows[i]) & (k <= highs[i]) & (at > untils[i])]), pa.int64())], ["i"])

    found = src.select(F.col("key").cast("long"), "at").mapInArrow(run, "i long").distinct().collect()
    return [known[x.i] for x in sorted(found)]


def part(source: DataFrame, payload: dict, key: str = "lsn", arrived: str = "arrived_at") -> DataFrame:
    """The rows of ``source`` that an item entered by ``advance`` covers."""
    out = source.filter((F.col(key) > payload["from"]) & (F.col(key) <= payload["to"]))
    if payload.get("until") is None:
        return out
    out = out.filter(_micros(arrived) <= payload["until"])
    return out if payload["after"] is None else out.filter(_micros(arrived) > payload["after"])


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _digits(n: int) -> str:
    return f"{n:019d}"


def lease_events(attempts: DataFrame, target: str = "target_id", ttl: float = TTL) -> DataFrame:
    """The ledger's events of a table of attempts: (target, from_lsn, to_lsn, token, kind).

    ``attempts`` has target, ``batch_id``, ``from_lsn``, ``to_lsn``, ``started_at``, ``ended_at`` and
    ``outcome``. Every attempt took a lease on its range; ``token`` (start, then batch_id) is its fencing
    token. ``kind`` is how the lease ended: ``done`` if acked; ``released`` if it has another outcome or
    an end; else ``leased``, and ``expired`` once ``ttl`` seconds have passed before the last thing the
    table tells of. Attempts without target, range or start are ignored; repeated rows are one event.
    """
    a = attempts.select(F.col(target).alias("target"), "from_lsn", "to_lsn", *[F.col(c).cast("timestamp").alias(c) for c in ("started_at", "ended_at")], "outcome", "batch_id")
    a = a.filter("target is not null and from_lsn < to_lsn and started_at is not null").distinct()
    now = a.agg(F.max(F.unix_micros(F.greatest("started_at", "ended_at")))).scalar()
    held = F.unix_micros("started_at") + int(ttl * 1e6) > now
    kind = F.when(F.col("outcome") == "acked", "done").when(F.col("outcome").isNotNull() | F.col("ended_at").isNotNull(), "released").when(held, "leased").otherwise("expired")
    return a.select("target", "from_lsn", "to_lsn", F.struct("started_at", "batch_id").alias("token"), kind.alias("kind"))


def ranges(attempts: DataFrame, target: str = "target_id", ttl: float = TTL) -> DataFrame:
    """Work items of a table of attempts: (target, lo, hi, state, token, done_at), for ``lo < key <= hi``.

    Each target's axis is cut where any attempt begins or ends, so attempts that overlap share items; the
    items cover the whole axis. The events over an item are folded in the order of their tokens: an
    item is ``done`` with the highest token that was acked, and an ack with a lower token is stale and
    cannot take the item's place back to its earlier start. An item that is not done is ``leased``
    while the highest token holds it, and ``pending`` if that was released or has expired. ``token``
    is the ``batch_id`` that decided, ``done_at`` its start if done: what arrived later was not part of it.

    An attempt's range is split into dyadic blocks, at most two a level; events are combined per block
    first, and an item takes those of the blocks it lies in. So the work grows with attempts times
    levels, however they overlap, and a target with very many attempts is spread over its blocks.
    """
    events = lease_events(attempts, target, ttl)
    base, top = events.agg(F.min("from_lsn"), F.max("to_lsn")).first()
    every = attempts.select(F.col(target).alias("target")).filter("target is not null").distinct()
    lowest, highest = F.lit(-(1 << 62)), F.lit(1 << 62)
    cuts = events.select("target", F.explode(F.array("from_lsn", "to_lsn")).alias("lo")).union(every.select("target", lowest)).distinct()
    items = cuts.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("target").orderBy("lo")), highest))
    levels = F.sequence(F.lit(0), F.lit((0 if base is None else top - base).bit_length()))
    first, last = F.col("from_lsn") + 1 - (base or 0), F.col("to_lsn") + 1 - (base or 0)  # [first, last) on an axis from 0

    def size(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def blocks(k: Column) -> Column:
        a, b = F.call_function("shiftright", first + size(k) - 1, k), F.call_function("shiftright", last, k)
        return F.array(F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("block"))), F.when((a < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("block"))))

    parts = F.explode(F.filter(F.flatten(F.transform(levels, blocks)), lambda x: x.isNotNull())).alias("b")
    per_block = events.select("target", parts, "token", "kind").groupBy("target", "b.level", "b.block").agg(F.max(F.when(F.col("kind") == "done", F.col("token"))).alias("done"), F.max(F.struct("token", "kind")).alias("last"))
    at = F.col("lo") + 1 - (base or 0)
    inside = items.filter((F.col("lo") >= (base or 0)) & (F.col("lo") < (top or 0)))
    above = F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", at, k).alias("block")))).alias("b")
    folded = inside.select("target", "lo", above).select("target", "lo", "b.level", "b.block").join(per_block, ["target", "level", "block"]).groupBy("target", "lo").agg(F.max("done").alias("done"), F.max("last").alias("last"))
    state = F.when(F.col("done").isNotNull(), "done").when(F.col("last.kind") == "leased", "leased").otherwise("pending")
    token = F.coalesce("done", "last.token")
    return items.join(folded, ["target", "lo"], "left").select("target", "lo", "hi", state.alias("state"), token["batch_id"].alias("token"), F.col("done.started_at").alias("done_at"))


def outstanding(records: DataFrame, items: DataFrame, key: str = "commit_lsn", arrived: str = "arrived_at") -> DataFrame:
    """The rows of ``records`` each target still has to process, with ``target``.

    A record is outstanding unless the item its ``key`` lies in is done and was begun at or after the
    record's arrival: a later record belongs to a follow-up of that item, which is pending. A leased
    item's records are outstanding until its holder is done. Unknown arrival counts as outstanding.

    Records look for their item in stretches of the axis, by an equi-join. There are about four
    stretches for the items of an average target, so the rows looked up are some times the items;
    they are broadcast only if, counted, they are at most ``BROADCAST_RANGES``. Above, records are
    salted within a stretch.
    """
    spark = items.sparkSession
    items = written(items.select("target", "lo", "hi", "done_at"), "items")
    n, targets, lo, hi = items.agg(F.count(F.lit(1)), F.countDistinct("target"), F.min(F.when(F.col("lo") > -(1 << 62), F.col("lo"))), F.max(F.when(F.col("hi") < 1 << 62, F.col("hi")))).first()
    lo, hi = lo or 0, max(hi or 0, (lo or 0) + 1)
    stretches = min(max(1, -(-4 * n // max(targets, 1))), 1 << 20)
    width = max(1, -(-(hi - lo) // stretches))
    clamp = lambda c: F.least(F.greatest(F.floor((c - lo) / width), F.lit(-1)), F.lit(stretches + 1)).cast("int")
    begin, end = clamp(F.col("lo")), clamp(F.col("hi"))
    rows = items.agg(F.sum(end - begin + 1)).first()[0] or 0
    near = items.withColumn("stretch", F.explode(F.sequence(begin, end)))
    records, on = records.withColumn("stretch", clamp(F.col(key))), ["stretch"]
    if rows <= BROADCAST_RANGES:
        near = F.broadcast(near)
    else:
        salts = 4 + int(spark.conf.get("spark.sql.shuffle.partitions")) // stretches
        near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        records, on = records.withColumn("salt", F.pmod(F.xxhash64(*records.columns), F.lit(salts)).cast("int")), ["stretch", "salt"]
    found = records.join(near, on).filter((F.col(key) > F.col("lo")) & (F.col(key) <= F.col("hi")))
    return found.filter(F.col("done_at").isNull() | F.col(arrived).isNull() | (F.col("done_at") < F.col(arrived))).drop(*on, "lo", "hi", "done_at")


def unshipped(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """(target_id, lsn): committed log records that each target's next run still has to ship."""
    from ..sources.log import committed

    records = log.filter("op not in ('BeginTxn', 'CommitTxn')").groupBy("lsn", "txn_id").agg(F.min(F.col("arrived_at").cast("timestamp")).alias("arrived_at"))
    return outstanding(committed(records, log), ranges(attempts)).select(F.col("target").alias("target_id"), "lsn")


def processed(log: DataFrame, root: str, waves: int = 2, parts: int = 8) -> DataFrame:
    """(lsn, commit_lsn) of the committed records, brought over by the items of a ledger in ``root``.

    The log is taken in ``waves`` by arrival, as if a run had come between them; each wave enters items
    for what is new, late and late-committed records among it, and does them. Every record is in the
    output of one item.
    """
    spark = log.sparkSession
    src = written(deliverable(log).repartitionByRange("commit_lsn").sortWithinPartitions("commit_lsn"), "deliverable")
    lo, hi, begin, until = src.agg(F.min("commit_lsn"), F.max("commit_lsn"), F.min(_micros("arrived_at")), F.max(_micros("arrived_at"))).first()
    ledger = WorkLedger(spark, root)
    for i in range(1, waves + 1) if hi is not None else ():
        there = src.filter(_micros("arrived_at") <= begin + (until - begin) * i // waves)
        advance(ledger, there, "commit_lsn", max(1, -(-(hi - lo + 1) // parts)))
        ledger.run("processed", lambda lease: part(src, lease.payload, "commit_lsn").select("lsn", "commit_lsn"))
    outs = [ledger.output(i) for i in ledger.items()]
    return spark.read.schema("lsn long, commit_lsn long").parquet(*outs) if outs else spark.createDataFrame([], "lsn long, commit_lsn long")
