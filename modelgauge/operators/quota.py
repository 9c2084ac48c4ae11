"""Fixed-window quota flags over a table of events.

A window opens at a key's first event after the previous window expired, so windows form a chain: from an event that opens one to the
first event at least a window length later. Nothing here holds a key:

1. Events get their place in their key by one range exchange, and a key is cut into segments of equal event count.
2. For keys of several segments, each segment tells, for every event that could be the first to open a window in it, when its last
   window expires ("exits"). Chains merge, so neighbouring events mostly share an exit and stand in one row.
3. An exit's successor is the first row that an entry at that time meets. Its place in the order of exits and in the merged order of
   rows and exits give it without a range join.
4. Rows reached from a key's first event are found by successor doubling: after k rounds all rows up to 2**k segments away are known.
   There are as many rounds as the longest key's number of segments has binary digits, none if no key has more than one.
5. Each segment is flagged on its own, given the window that is still open when it starts. A window may span any number of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modelgauge.functions.ordered import ranked, same, stored

SEGMENT_EVENTS = 4096


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches of whole segments (rows sorted by key, segment, pos) and where their segments begin; one segment at most is held back."""
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch], all_: bool) -> tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        begins = np.flatnonzero(whole.column("pos").to_numpy() % size == 0)
        to = whole.num_rows if all_ else int(begins[-1])
        return whole.slice(0, to), whole.slice(to), begins[begins < to]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if (batch.column("pos").to_numpy() % size == 0).any():
            done, rest, begins = cut(held, False)
            held = [rest]
            if done.num_rows:
                yield done, begins
    if held:
        done, _, begins = cut(held, True)
        yield done, begins


def _exits(width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row (key, seg, upto, exit, start_pos) for neighbouring entry events with the same exit: the last entry's time, the moment the
    segment's last window expires, and the place of the event that opened it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _segments(batches, size):
            us, pos = rows.column("us").to_numpy(), rows.column("pos").to_numpy()
            take, columns = [], ([], [], [])
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(us)], strict=True):
                t = us[a:b]
                following = np.searchsorted(t, t + width, side="left").tolist()
                last = list(range(len(t)))
                for i in range(len(t) - 1, -1, -1):
                    if following[i] < len(t):
                        last[i] = last[following[i]]
                entries = 1 if pos[a] == 0 else min(len(t), int(np.searchsorted(t, t[0] + width, side="left")) + 1)
                opened = t[last[:entries]]
                first = np.flatnonzero(np.r_[True, opened[1:] != opened[:-1]])
                until = np.r_[first[1:], entries] - 1
                take += [a] * len(first)
                for column, values in zip(columns, (t[until], opened[first] + width, pos[a] + np.array(last)[first]), strict=True):
                    column.append(values)
            kept = rows.select(["key", "seg"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(np.concatenate(c)) for c in columns)], ["key", "seg", "upto", "exit", "start_pos"])

    return run


def _flags(width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the window's start and the place of its first event to rows that carry the window open at their segment's start (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _segments(batches, size):
            us, pos = rows.column("us").to_numpy(), rows.column("pos").to_numpy()
            open_until = rows.column("open_until")
            start, first = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(us)], strict=True):
                t = us[a:b]
                following = np.searchsorted(t, t + width, side="left").tolist()
                until = open_until[a].as_py()
                i, opens = 0 if until is None else int(np.searchsorted(t, until, side="left")), []
                while i < len(t):
                    opens.append(i)
                    i = following[i]
                opens = np.array(opens, np.int64)
                of = np.searchsorted(opens, np.arange(len(t)), side="right") - 1
                start[a:b] = t[opens[of]] if len(opens) else 0
                first[a:b] = pos[a] + opens[of] if len(opens) else 0
                if until is not None:
                    head = of < 0
                    start[a:b][head] = until - width
                    first[a:b][head] = rows.column("open_pos")[a].as_py()
            names = [n for n in rows.schema.names if n not in ("key", "us", "seg", "open_until", "open_pos")]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(start), pa.array(pos - first + 1)], [*names, "start", "position"])

    return run


def _carried(events: DataFrame, width: int, size: int, most: int) -> DataFrame:
    """key, seg, open_until, open_pos: the window that is open when a segment other than a key's first one starts."""
    tall = events.where(F.col("n") > size)
    key_type = events.schema["key"].dataType.simpleString()
    slim = tall.select("key", "seg", "pos", "us").repartition("key", "seg").sortWithinPartitions("key", "seg", "pos")
    exits = slim.mapInArrow(_exits(width, size), f"key {key_type}, seg long, upto long, exit long, start_pos long")
    exits = ranked(exits, ["key"], [F.col("seg"), F.col("upto")]).withColumnsRenamed({"pos": "g", "n": "rows"})
    exits = stored(exits)
    asked = ranked(exits.select("key", F.col("exit").alias("at"), "g"), ["key"], [F.col("at"), F.col("g")]).select("key", "at", F.lit(0).alias("kind"), "g", F.col("pos").alias("own"))
    entries = exits.select("key", F.col("upto").alias("at"), F.lit(1).alias("kind"), "g", F.col("g").alias("own"))
    merged = ranked(entries.union(asked), ["key"], [F.col("at"), F.col("kind"), F.col("own")]).where("kind = 0")
    # of the places before an exit, `own` hold earlier exits; the others hold rows that are over by then
    jump = stored(merged.select("key", "g", (F.col("pos") - F.col("own")).alias("next")))
    successor = jump.select(F.col("key").alias("k"), F.col("g").alias("from"), "next")

    reached = jump.where("g = 0").select("key", "g")
    for _ in range((-(-most // size)).bit_length()):
        further = reached.join(jump.select(F.col("key").alias("k"), F.col("g").alias("from"), "next"), F.col("key").eqNullSafe(F.col("k")) & (F.col("g") == F.col("from")))
        reached = stored(reached.union(further.select("key", F.col("next").alias("g"))).distinct())
        ahead = jump.select(F.col("key").alias("k"), F.col("g").alias("from"), F.col("next").alias("then"))
        jump = stored(jump.join(ahead, F.col("key").eqNullSafe(F.col("k")) & (F.col("next") == F.col("from"))).select("key", "g", F.col("then").alias("next")))

    met = exits.join(reached.withColumnsRenamed({"key": "k", "g": "from"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("g") == F.col("from"))).drop("k", "from")
    met = met.join(successor, F.col("key").eqNullSafe(F.col("k")) & (F.col("g") == F.col("from"))).drop("k", "from")
    there = exits.select(F.col("key").alias("k"), F.col("g").alias("at"), F.col("seg").alias("to"))
    met = met.join(there, F.col("key").eqNullSafe(F.col("k")) & (F.col("next") == F.col("at")), "left").drop("k")
    ends = tall.groupBy(F.col("key").alias("k")).agg(F.max("seg").alias("end"))
    met = met.join(ends, F.col("key").eqNullSafe(F.col("k"))).withColumn("to", F.coalesce("to", "end")).where("to > seg")
    return met.select("key", F.explode(F.sequence(F.col("seg") + 1, F.col("to"))).alias("seg"), F.col("exit").alias("open_until"), F.col("start_pos").alias("open_pos"))


def quota_flags(events: DataFrame, key: str, ts: str, window_seconds: int, limit: int, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """events + window_start, position, allowed, retry_after (seconds, 0 when allowed).

    Events of the same moment are taken in the order of their other columns. A null key is a key; rows without a time are not events
    and are left out.
    """
    width = window_seconds * 1_000_000
    others = [c for c in events.columns if c not in (key, ts)]
    base = events.where(F.col(ts).isNotNull()).select(F.struct(*events.columns).alias("row"), F.col(key).alias("key"), F.unix_micros(ts).alias("us"))
    placed = ranked(base, ["key"], [F.col("us"), *(F.col(f"row.`{c}`") for c in others)])
    rows = placed.withColumn("seg", F.floor(F.col("pos") / segment_events))
    most = placed.agg(F.max("n")).first()[0] or 0
    if most > segment_events:
        carried = _carried(rows, width, segment_events, most).withColumnsRenamed({"key": "k", "seg": "s"})
        rows = rows.join(carried, same(rows, carried, [("key", "k"), ("seg", "s")]), "left").drop("k", "s")
    else:
        rows = rows.withColumns({"open_until": F.lit(None).cast("long"), "open_pos": F.lit(None).cast("long")})
    sent = rows.select("row", "key", "us", "seg", "pos", "open_until", "open_pos").repartition("key", "seg").sortWithinPartitions("key", "seg", "pos")
    out = StructType([sent.schema["row"], StructField("pos", LongType()), StructField("start", LongType()), StructField("position", LongType())])
    flagged = sent.mapInArrow(_flags(width, segment_events), out)
    late = F.col("position") > limit
    wait = F.greatest(F.lit(1), F.ceil((F.col("start") + width - F.unix_micros(F.col(f"row.`{ts}`"))) / 1_000_000))
    return flagged.select(
        *(F.col(f"row.`{c}`").alias(c) for c in events.columns), F.timestamp_micros("start").alias("window_start"), "position",
        (~late).alias("allowed"), F.when(late, wait).otherwise(0).cast("bigint").alias("retry_after"),
    )
