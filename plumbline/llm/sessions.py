"""Sessions of clicks by a speculative parallel scan.

Clicks are dealt by ranges of (client, time), so that a client of any size is
spread over as many parts as it needs.  Every part is scanned at once as if a
session began with its first click.  That guess can only matter up to the
part's first certain start: the first click of another client, or one behind a
final click or a gap.  From there on sessions are written as they are; the
clicks before, the part's head, are kept with the guessed cuts, and so is one
edge a part: its first client and the session open at its end.

Edges are then exchanged: each part gets the session that the part before left
open.  Where that isn't what it had assumed, its head is scanned again until a
cut falls on a guessed one, from where on the guess was right.  A part without
any certain start may thereby leave another session open, so edges are
exchanged again until none changes; a chain of k such parts whose cuts never
meet takes k rounds.  Heads, edges and pieces are tables: nothing is collected,
broadcast or sent through one task.

Sessions that cross a batch or a part are written as pieces and put together by
tasks that stream them: what they hold doesn't grow with a session.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from plumbline.store import discard, stash

MINUTE = 60_000_000
#: Why a click begins a session: the one before is final, too long ago, the session is too long; its client's first; its part's scan has it already.
END, GAP, LENGTH, FIRST, BEYOND = 1, 2, 3, 4, 5
REASONS = ["none", "end", "gap", "length"]
#: A row is a run of clicks: a whole session, a piece of one, a click of a head (session: its id), or an edge (client: the first, last: that of the open session).
ROWS = "what string, part int, seq long, client long, last long, session long, start long, end long, n long, n_late long, cents long, final boolean, reason int, path string"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ROWS.split(", ")])


def micros(at: Column, ntz: bool) -> Column:
    """Microseconds since 1970; of a time without a zone as if it were UTC, whatever the session's zone."""
    if not ntz:
        return F.unix_micros(at)
    i = at - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), i)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


@dataclass(frozen=True)
class Open:
    """The session open at a place: its client and first click, when it began, its last click's time and whether that is final."""

    client: int
    session: int
    start: int
    end: int
    final: bool


@dataclass
class Clicks:
    """Clicks in order, as arrays."""

    client: np.ndarray
    id: np.ndarray
    at: np.ndarray
    timely: np.ndarray
    cents: np.ndarray
    final: np.ndarray

    def __getitem__(self, rows: slice) -> Clicks:
        return Clicks(*(getattr(self, f)[rows] for f in self.__dataclass_fields__))


def cuts(c: Clicks, open_: Open | None, gap: int, length: int, guess: np.ndarray | None = None) -> np.ndarray:
    """Why each click begins a session, or 0; guess: cuts that hold from the first that is met on."""
    out = np.zeros(len(c.at), np.int32)
    t = np.flatnonzero(c.timely)
    if not len(t):
        return out
    who, at, final = c.client[t], c.at[t], c.final[t]
    same = np.concatenate([[open_ is not None and who[0] == open_.client], who[1:] == who[:-1]])
    before = np.concatenate([[open_.end if open_ else at[0]], at[:-1]])
    ended = np.concatenate([[open_ is not None and open_.final], final[:-1]])
    why = np.where(~same, FIRST, np.where(ended, END, np.where(at - before >= gap, GAP, 0))).astype(np.int32)
    known = np.zeros(len(t), np.int32) if guess is None else guess[t]
    hard = np.flatnonzero(why)
    begin = hard if why[0] else np.concatenate([[0], hard])
    start = at[begin].copy()
    if not why[0]:
        start[0] = open_.start
    stop = np.append(begin[1:], len(t))
    for k in np.flatnonzero(at[stop - 1] - start > length).tolist():
        i, s, e = int(begin[k]), int(start[k]), int(stop[k])
        while (i := i + int(np.searchsorted(at[i:e], s + length, side="right"))) < e:
            if known[i]:
                why[i:e] = np.where(known[i:e] > 0, LENGTH, 0)
                break
            why[i], s = LENGTH, int(at[i])
    out[t] = why
    return out


def after(c: Clicks, why: np.ndarray, open_: Open | None) -> Open | None:
    """The session open behind these clicks."""
    t = np.flatnonzero(c.timely)
    if not len(t):
        return open_
    z, last = np.flatnonzero(why), t[-1]
    if len(z):
        return Open(int(c.client[z[-1]]), int(c.id[z[-1]]), int(c.at[z[-1]]), int(c.at[last]), bool(c.final[last]))
    return Open(open_.client, open_.session, open_.start, int(c.at[last]), bool(c.final[last]))


def runs(c: Clicks, why: np.ndarray, open_: Open | None, part: int, seq: int, beyond: bool = False) -> pa.RecordBatch:
    """These clicks' whole sessions, and pieces of that open before and, unless it is another scan's (beyond), that open behind them."""
    z = np.flatnonzero(why)
    at = np.concatenate([[0], np.cumsum(c.timely)])
    t = np.flatnonzero(c.timely)
    names = list(map(str, c.id[t].tolist()))
    text = lambda low, high: ",".join(names[at[low] : at[high]])

    def piece(seq, low, high, who, session, start, reason):
        mine, own = t[at[low] : at[high]], c.client[low:high] == who
        end, final = (int(c.at[mine[-1]]), bool(c.final[mine[-1]])) if len(mine) else (None, None)
        row = ["piece", part, seq, who, None, session, start, end, len(mine), int((own & ~c.timely[low:high]).sum()), int(c.cents[mine].sum()), final, reason, text(low, high)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    out = []
    if open_ is not None:
        closing = int(why[z[0]]) if len(z) and why[z[0]] < FIRST else None
        out.append(piece(seq, 0, int(z[0]) if len(z) else len(c.at), open_.client, open_.session, open_.start, closing))
    some = len(z) - 1
    if some > 0:  # whole sessions, each sum by one pass
        low, high = z[:-1], z[1:]
        who, sid, rows = c.client[low], np.repeat(np.arange(some), high - low), slice(int(z[0]), int(z[-1]))
        last, timely = t[at[high] - 1], c.timely[rows]
        closed = np.where(why[high] < FIRST, why[high], np.where(c.final[last], END, 0))
        digest = [hashlib.sha256(text(a, b).encode()).hexdigest() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        cols = {
            "what": ["whole"] * some, "part": np.full(some, part), "seq": np.arange(some) + seq + 1, "client": who, "session": c.id[low], "start": c.at[low], "end": c.at[last], "n": at[high] - at[low],
            "n_late": np.add.reduceat((~timely & (c.client[rows] == who[sid])).astype(np.int64), low - z[0]), "cents": np.add.reduceat(np.where(timely, c.cents[rows], 0), low - z[0]), "final": c.final[last], "reason": closed, "path": digest,
        }
        out.append(_batch(cols, some))
    if len(z) and not beyond:
        k = int(z[-1])
        out.append(piece(seq + some + 1, k, len(c.at), int(c.client[k]), int(c.id[k]), int(c.at[k]), None))
    return pa.concat_batches(out) if out else _batch({}, 0)


def _batch(cols: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _edge(part: int, first: int, is_open: bool, o: Open | None) -> pa.RecordBatch:
    row = ["edge", part, None, first, *((o.client, o.session, o.start, o.end) if o else [None] * 4), None, None, None, o.final if o else None, int(is_open), None]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def _heads(c: Clicks, why: np.ndarray, part: int, seq: int) -> pa.RecordBatch:
    n = len(c.at)
    cols = {"what": ["head"] * n, "part": np.full(n, part), "seq": np.arange(seq, seq + n), "client": c.client, "session": c.id, "start": c.at, "n": c.timely.astype(np.int64), "cents": c.cents, "final": c.final, "reason": why}
    return _batch(cols, n)


def _np(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _scan(gap: int, length: int):
    """Clicks of a part in order to whole sessions, pieces, the head and the edge."""

    def run(batches):
        part, first, is_open, o, seq = TaskContext.get().partitionId(), None, True, None, 0
        for b in batches:
            if not len(b):
                continue
            c = Clicks(*(_np(b, f) for f in ("client", "id", "at", "timely", "cents", "final")))
            first = int(c.client[0]) if first is None else first
            if is_open:
                why = cuts(c, o, gap, length)
                sure = np.flatnonzero((why == END) | (why == GAP) | ((why == FIRST) & (c.client != first)))
                k = int(sure[0]) if len(sure) else len(c.at)
                head = np.where(np.arange(len(why)) == k, BEYOND, why)[: k + 1]
                yield _heads(c[: k + 1], head, part, seq)
                seq += len(head)
                if not len(sure):
                    o = after(c, why, o)
                    continue
                is_open, o, c = False, None, c[k:]
            why = cuts(c, o, gap, length)
            out = runs(c, why, o, part, seq)
            seq, o = seq + len(c.at) + 1, after(c, why, o)
            yield out
        if first is not None:
            yield _edge(part, first, is_open, o)

    return run


def _again(gap: int, length: int, whole: bool):
    """Heads behind their entries (seq -1, by part) to sessions and pieces, or (part, the session open at the end)."""

    def run(batches):
        part, o, seq, entered = None, None, 0, None
        for b in batches:
            if not len(b):
                continue
            parts, at = _np(b, "part"), np.concatenate([[0], np.flatnonzero(np.diff(_np(b, "part"))) + 1])
            for low, high in zip(at.tolist(), [*at[1:].tolist(), len(parts)], strict=True):
                if parts[low] != part:
                    if part is not None and not whole:
                        yield _edge(part, 0, True, o)
                    entry = {f: b.column(f)[low].as_py() for f in ("last", "session", "start", "end", "final")}
                    part, seq = int(parts[low]), 0
                    o = None if entry["last"] is None else Open(*entry.values())
                    entered, low = o, low + 1
                if low == high:
                    continue
                s = b.slice(low, high - low)
                c = Clicks(_np(s, "client"), _np(s, "session"), _np(s, "start"), _np(s, "n") == 1, _np(s, "cents"), _np(s, "final").astype(bool))
                guess = _np(s, "reason").astype(np.int32)
                beyond = guess[-1] == BEYOND
                why = cuts(c, o, gap, length, guess % BEYOND if entered is not None else None)
                if whole:
                    out = runs(c, why, o, part, seq, bool(beyond))
                    seq += len(c.at) + 1
                    yield out
                o = after(c, why, o)
        if part is not None and not whole:
            yield _edge(part, 0, True, o)

    return run


_SESSIONS = "client long, session long, start long, end long, n long, n_late long, cents long, reason int, path string"


def _joined(batches):
    """Pieces in order, those of a session in a row, to sessions."""
    key, sums, end, final, reason, sha, cut = None, None, None, None, 0, None, ""

    def closed():
        row = [*key, end, *sums, reason or (END if final else 0), sha.hexdigest()]
        types = [_TYPES[f.split()[1]] for f in _SESSIONS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [f.split()[0] for f in _SESSIONS.split(", ")])

    for b in batches:
        for r in b.to_pylist():
            k = (r["client"], r["session"], r["start"])
            if k != key:
                if key is not None:
                    yield closed()
                key, sums, end, final, reason, sha, cut = k, [0, 0, 0], None, None, 0, hashlib.sha256(), ""
            sums = [sums[0] + r["n"], sums[1] + r["n_late"], sums[2] + r["cents"]]
            reason = r["reason"] or reason
            if r["n"]:
                end, final = r["end"], r["final"]
                sha.update((cut + r["path"]).encode())
                cut = ","
    if key is not None:
        yield closed()


def _exchanged(edges: DataFrame, heads: DataFrame, gap: int, length: int) -> DataFrame:
    """(part, entry): the session that is open before each part."""
    spark = edges.sparkSession
    state = "struct<last: long, session: long, start: long, end: long, final: boolean>"
    left = F.when(F.col("last").isNotNull(), F.struct("last", "session", "start", "end", "final")).cast(state)
    parts = (edges.agg(F.max("part")).first()[0] + 1) if edges.head(1) else 0
    # a part without rows has no edge: it leaves open what was open before it
    now = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(edges.select("part", F.col("client").alias("first"), (F.col("reason") == 1).alias("open"), left.alias("left")), "part", "left")
    now = now.select("part", "first", F.coalesce("open", F.lit(True)).alias("open"), "left", F.lit(None).cast(state).alias("assumed"))
    old = None
    while True:
        before = now.select((F.col("part") + 1).alias("part"), F.col("left").alias("entry"))
        at = now.join(before.hint("merge"), "part", "left")
        at = stash(at.withColumn("entry", F.when(F.col("first").isNull() | (F.col("first") == F.col("entry.last")), F.col("entry"))), "edges")
        if old is not None:
            discard(old)
        old = at
        wrong = at.where("open AND NOT entry <=> assumed")
        if not wrong.head(1):
            return at.select("part", "entry")
        again = _entered(heads.join(wrong.select("part").hint("merge"), "part", "left_semi"), wrong).mapInArrow(_again(gap, length, False), ROWS)
        again = again.select("part", F.lit(True).alias("ran"), left.alias("new"))
        now = at.join(again.hint("merge"), "part", "left").select("part", "first", "open", F.when(F.col("ran"), F.col("new")).otherwise(F.col("left")).alias("left"), F.when(F.col("open"), F.col("entry")).alias("assumed"))


def _entered(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """Heads in order, each part's behind the session open before it."""
    have = {"part": F.col("part"), "seq": F.lit(-1).cast("long")} | {f: F.col(f"entry.{f}") for f in ("last", "session", "start", "end", "final")}
    empty = [(have[f] if f in have else F.lit(None).cast(t)).alias(f) for f, t in (c.split() for c in ROWS.split(", "))]
    return heads.select(*_NAMES).union(entries.select(*empty)).repartition("part").sortWithinPartitions("part", "seq")


def sessionise(
    clicks: DataFrame, final: Column, gap: int = 10 * MINUTE, length: int = 40 * MINUTE, late: int = 360 * MINUTE,
    client: str = "client_id", key: str = "click_id", at: str = "ts", arrived: str = "arrived_at", value: str = "value", parts: int | None = None,
) -> DataFrame:
    """(client, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256) of every session.

    final: a condition on clicks; null is false.  gap, length, late: microseconds.
    A click without key, client or time is left out; of several with one key the
    first to arrive is taken (no arrival before any, then the least time and
    client).  A click that never arrived isn't late; a null, NaN or too large
    value is 0.  Ties in time are in order of the key.  A client's late clicks
    before its first session are in none; no clicks make no sessions.  Further
    columns are ignored.  parts: ranges of clicks, spark.sql.shuffle.partitions
    unless given.
    """
    spark = clicks.sparkSession
    ntz = {c: isinstance(clicks.schema[c].dataType, TimestampNTZType) for c in (at, arrived)}
    hundreds = 100 * F.col(value).cast("double") + 0.5
    cents = F.when(F.abs(hundreds) < 2.0**63, F.floor(hundreds)).otherwise(0)
    d = clicks.select(
        F.col(client).cast("long").alias("client"), F.col(key).cast("long").alias("id"), micros(F.col(at), ntz[at]).alias("at"), micros(F.col(arrived), ntz[arrived]).alias("arrived"),
        cents.cast("long").alias("cents"), F.coalesce(final, F.lit(False)).alias("final"),
    )
    d = d.where("client IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL")
    d = d.groupBy("id").agg(F.min(F.struct("arrived", "at", "client", "cents", "final")).alias("c")).select("id", "c.*")
    d = d.withColumn("timely", F.coalesce(F.col("arrived") - F.col("at") <= late, F.lit(True)))
    d = d.select("client", "id", "at", "timely", "cents", "final")
    order = ["client", "at", F.col("timely").desc(), "id"]
    d = d.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = stash(d.mapInArrow(_scan(gap, length), ROWS), "sessions")
    heads = rows.where("what = 'head'")
    entries = _exchanged(rows.where("what = 'edge'"), heads, gap, length)
    again = stash(_entered(heads, entries).mapInArrow(_again(gap, length, True), ROWS), "heads")
    both = rows.where("what IN ('whole', 'piece')").union(again)
    pieces = both.where("what = 'piece'").repartition("client", "session").sortWithinPartitions("client", "session", "start", "part", "seq")
    cols = [c.split()[0] for c in _SESSIONS.split(", ")]
    out = both.where("what = 'whole'").select(*cols).union(pieces.mapInArrow(_joined, _SESSIONS))
    return out.select(
        F.col("client").alias(client), F.col("session").alias("session_id"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("n").alias("n_clicks"), "n_late", F.col("cents").alias("value_cents"),
        F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1).alias("closed_by"), F.col("path").alias("path_sha256"),
    )
