"""Pages of a range result under a byte budget, and cursors that continue after a key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.session import written

UINT64_TAG, INT64_MAX = 6, (1 << 63) - 1


def _digits_above_signed(data: bytes) -> int:
    """Decimal digits of an unsigned number that JSON carries as text, else 0."""
    number = int.from_bytes(data[1:], "big")
    return len(str(number)) if data[0] == UINT64_TAG and number > INT64_MAX else 0


def fold_pages(records: Iterable[tuple[bytes, bytes]], limit: int) -> Iterator[int]:
    """Page number of each record, in order.

    A page's budget counts key and value bytes and the extra digits of what it holds so far. The
    record that exceeds it still belongs to the page, and its bytes count against the next one.
    """
    page, used, extra = 0, 0, 0
    for key, value in records:
        more = _digits_above_signed(key) + _digits_above_signed(value)
        extra += more
        size = len(key) + len(value)
        full = size + more + used + extra > limit
        yield page
        if full:
            page, used, extra = page + 1, size, 0
        else:
            used += size


def _large_digits(data: pa.Array) -> np.ndarray:
    """`_digits_above_signed` of each value; only those that may be so large are looked at one by one."""
    above = pc.or_(pc.greater_equal(pc.binary_slice(data, 1, 2), b"\x80"), pc.greater(pc.binary_length(data), 9))
    may = pc.and_(pc.equal(pc.binary_slice(data, 0, 1), bytes([UINT64_TAG])), above)
    out = np.zeros(len(data), np.int64)
    out[may.to_numpy(zero_copy_only=False)] = [_digits_above_signed(d) for d in data.filter(may).to_pylist()]
    return out


class Starts:
    """Where pages begin in one range of sorted records, for every state that the fold may enter it in.

    A state is one number: bytes and digits that the open page has used, 0 to limit + 1 (more acts alike). A page
    that begins later never ends earlier, and the fullest state's second page begins after any other state's first.
    So at each record all states have begun as many pages as the fullest or one less, and those with one less are
    the states below some number. Steps are the intervals of states that have not come to the same since, fullest
    first; they are no more than the records of a page.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.low = self.now = np.empty(0, np.int64)  # of each step: its least state at entry, its state now
        self.unfilled = limit + 2  # states below it have filled no page yet
        self.used = 0  # what the range so far adds to these
        self.pages = 0  # begun by the fullest state
        self.behind = 0  # how many steps, the last ones, have begun one less

    def add(self, size: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each further record (at least one): pages begun by the fullest state, and below which state it is one less."""
        n, limit = len(size), self.limit
        at = np.concatenate(([0], np.cumsum(size + more)))
        need = np.append(at[1:] + more, np.iinfo(np.int64).max)
        most = np.maximum.accumulate(need[:n])

        def next_start(begin: np.ndarray, state: np.ndarray) -> np.ndarray:
            """The record after the first one, from begin on, that fills a page which has this state at begin; else 0."""
            room = limit - state + at[begin]
            full = np.maximum(np.searchsorted(most, room, "right"), begin)
            for i in np.flatnonzero(need[full] <= room):  # only a record before begin needs so much
                full[i] = next(j for j in range(full[i], n + 1) if need[j] > room[i])
            return np.where(full < n, full + 1, 0)

        carried = np.minimum(size, limit + 1)
        after = [0, *next_start(np.arange(1, n + 1), carried).tolist()]
        reached = np.minimum.accumulate(np.append(self.unfilled, np.maximum(limit + 1 - self.used - most, 0)))
        filling = np.flatnonzero(reached[1:] < reached[:-1])  # records that fill the first page of some states
        first = np.concatenate((next_start(np.zeros(len(self.now), np.int64), self.now), filling + 1))
        low = np.concatenate((self.low, reached[filling + 1]))
        self.unfilled, self.used = int(reached[n]), self.used + int(at[n])

        begun = np.bincount(first[first > 0], minlength=n + 1).tolist()  # steps with a page that begins at a record
        for p in range(1, n):
            if begun[p] and after[p]:
                begun[after[p]] += begun[p]
        last = list(range(n + 1))  # the last page that follows one
        for p in range(n - 1, 0, -1):
            if after[p]:
                last[p] = last[after[p]]
        lead, p = np.zeros(n + 1, np.int64), int(first[0])
        while p:
            lead[p], p = 1, after[p]
        lead = np.cumsum(lead)

        rest = int(self.unfilled > 0)  # the states that have filled none are a step too
        bounds = np.append(low, 0) if rest else low
        behind = self.behind + self.pages * (len(filling) + rest) + len(bounds) * lead - np.cumsum(begun)
        high, below = self.pages + lead, bounds[len(bounds) - 1 - behind]

        self.pages = int(high[n])
        late = np.arange(len(low)) >= len(low) - (int(behind[n]) - self.pages * rest)
        final = np.array(last)[first]
        now = np.where(first > 0, carried[final - 1] - at[final], np.append(self.now, filling)) + at[n]
        keep = np.append((now[1:] != now[:-1]) | (late[1:] != late[:-1]), True)
        self.low, self.now, self.behind = low[keep], now[keep], int(late[keep].sum())
        return high[:n], below[:n]

    def end(self) -> list[tuple[int, int, int]]:
        """What the range does to a state: from each least state on, pages begun and the state then. Without a page, used is added."""
        late = len(self.low) - self.behind
        steps = [(int(low), self.pages - (i >= late), int(now)) for i, (low, now) in enumerate(zip(self.low, self.now))]
        return [*steps, (0, 0, self.used)] if self.unfilled else steps


def assign_pages(rows: DataFrame, limit: int) -> DataFrame:
    """rows (key, value; already resolved and visible) with their page.

    The budget resets at every page, so pages are a sequential fold by definition. Sorted ranges are folded apart,
    each for all states at once, and written once with their steps; the driver chains the steps (a few for each
    range), and then each record knows its page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts = ["key", "value", "high", "below", "state"], Starts(limit)
        for b in batches:
            if b.num_rows:
                size = sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in b.columns)
                high, below = starts.add(size, sum(map(_large_digits, b.columns)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(high), pa.array(below), pa.nulls(b.num_rows, pa.int64())], names=names)
        if starts.pages:  # as soon as there is a record
            low, pages, state = (pa.array(c, pa.int64()) for c in zip(*starts.end()))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(low), pa.binary())] * 2, pages, low, state], names=names)

    ranges = rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key")
    folded = written(ranges.mapInArrow(run, "key binary, value binary, high long, below long, state long").withColumn("part", F.spark_partition_id()))
    ends: dict[int, list] = {}
    for e in folded.where("state is not null").select("part", "below", "high", "state").collect():
        ends.setdefault(e.part, []).append((e.below, e.high, e.state))
    page, used, entered = 0, 0, []
    for part in sorted(ends):
        entered.append((part, page, used))
        _, more, state = max(e for e in ends[part] if e[0] <= used)
        page, used = page + more, state if more else used + state
    entries = F.broadcast(rows.sparkSession.createDataFrame(entered, "part int, page long, used long"))
    page_of = F.col("page") + F.col("high") - (F.col("used") < F.col("below")).cast("long")
    return folded.where("state is null").join(entries, "part").select("key", "value", page_of.alias("page"))


@dataclass
class Cursor:
    """An open range: each page reads what follows the last key, on the same snapshot."""

    rows: DataFrame  # key, value; visible, of one snapshot
    limit: int
    last_key: bytes | None = None
    used: int = 0
    done: bool = False

    def page(self) -> list[tuple[bytes, bytes]]:
        """The next page in key order; empty at the end."""
        if self.done:
            return []
        rest = self.rows if self.last_key is None else self.rows.where(F.col("key") > F.lit(self.last_key))
        out, used, extra = [], self.used, 0
        self.done = True
        for r in rest.orderBy("key").limit(self.limit + 1).toLocalIterator():  # a record has a byte at least
            key, value = bytes(r["key"]), bytes(r["value"])
            more = _digits_above_signed(key) + _digits_above_signed(value)
            extra += more
            out.append((key, value))
            if len(key) + len(value) + more + used + extra > self.limit:
                self.last_key, self.used, self.done = key, len(key) + len(value), False
                break
            used += len(key) + len(value)
        return out
