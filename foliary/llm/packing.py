"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. Only the counts of each length matter for the plan, at most
``capacity`` numbers, so the plan is made once from a histogram, whatever the number of documents:

1. lengths above ``capacity * small`` are large; sorted downwards they are cut into groups of equal cardinality,
   and each is rounded up to the largest of its group (no more lengths than groups stay as they are);
2. few sizes remain, so configurations (multisets of sizes that fit one sequence) are optimised by column
   generation: a linear programme over patterns, new patterns by a knapsack, then rounding down;
3. actual lengths take the slots: each the longest that its size allows, the last slot of a sequence the longest that its room
   allows, so that little of what rounding up cost is lost; what rounding down left is grouped and optimised again;
4. what no whole configuration takes, and small lengths, largest first, go best-fit into the room that is left.

All of this runs on runs of equal sequences, so it costs the same for a thousand documents and for a trillion.
Documents then find their sequences by their rank among equal lengths, which comes from a two-level prefix sum.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise
from .tokens import default_path, encoder

GROUPS = 96
#: Lengths above this share of the capacity are large.
SMALL = 1 / 5
#: Times that what is left of the large lengths is grouped and optimised again.
ROUNDS = 3
#: Each length is ranked in prefix-sum buckets, so that one which a third of all pieces share is ranked in parallel: at least so many,
#: and so many that a bucket holds about ``IN_BUCKET`` pieces even if all are of one length.
BUCKETS, IN_BUCKET = 256, 500_000


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: texts encoded whole, cut only if longer than ``capacity``.

    The first piece is the shorter one, all others are full. A null text is an empty one; ``end_id`` ends each.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                keys = part.column("id").to_pylist()
                rows: list[tuple] = []
                for key, ids in zip(keys, enc.encode(part.column("text").to_pylist(), end_id), strict=True):
                    n, at, k = len(ids), 0, 0
                    raw = ids.astype("<u4").tobytes()
                    while at < n:
                        to = at + ((n - at) % capacity or capacity)
                        rows.append((key, k, at, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                        at, k = to, k + 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) with whole times, from the linear programme min sum x, sum pattern * x >= demand, rounded down."""
    m = len(sizes)
    cols = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inv = np.linalg.inv(cols)
    x = inv @ demand
    for step in range(rounds):
        y = np.ones(m) @ inv
        # knapsack over exact room: best value of patterns that fill at most c
        best = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fit = sizes <= c
            v = np.where(fit, best[np.where(fit, c - sizes, 0)] + y, -1.0)
            k = int(np.argmax(v))
            if v[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = v[k], k
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
                continue
            new[pick[c]] += 1
            c -= int(sizes[pick[c]])
        d = inv @ new
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        cols[:, out] = new
        if step % 50 == 49:
            inv = np.linalg.inv(cols)
        else:
            row = inv[out] / d[out]
            inv = inv - np.outer(d, row)
            inv[out] = row
        x = inv @ demand
        x[x < 0] = 0
    return [(cols[:, i].astype(int), int(x[i] + 1e-6)) for i in range(m) if x[i] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL, rounds: int = ROUNDS) -> list[tuple[int, list[int]]]:
    """(times, lengths): ``times`` sequences that each hold these lengths. Every piece of the histogram is in one.

    Large lengths are grouped and optimised up to ``rounds`` times, each time those that the time before left over.
    """
    left = {n: c for n, c in histogram.items() if c}
    runs: list[tuple[int, list[int]]] = []
    if full := left.pop(capacity, 0):
        runs.append((full, [capacity]))
    for _ in range(rounds):
        large = {n: left[n] for n in left if n > capacity * small}
        placed = _configured(large, capacity, groups)
        if not placed:
            break
        runs += placed
        left = {n: c for n, c in left.items() if n <= capacity * small} | large
    return _best_fit(runs, left, capacity)


def _configured(large: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[int]]]:
    """Sequences by the best configurations of the rounded lengths; what they hold is taken from ``large``."""
    demand = _rounded(large, groups)
    if not demand:
        return []
    order = sorted(demand, reverse=True)
    chosen = _patterns(np.array(order), np.array([demand[s] for s in order], float), capacity)
    lengths = sorted(large)
    # long slots first: they find what their size allows, and the last slots of others make up for the rest
    found = [([s for s, k in zip(order, pattern, strict=True) for _ in range(k)], times) for pattern, times in chosen]
    return [run for slots, times in sorted(found, reverse=True) for run in _substitute(large, lengths, slots, times, capacity)]


def _rounded(large: dict[int, int], groups: int) -> dict[int, int]:
    """Demand of each size: lengths sorted downwards in groups of equal cardinality, each rounded up to the largest of its group.

    No more lengths than groups need no rounding.
    """
    if len(large) <= groups:
        return dict(large)
    share = -(-sum(large.values()) // groups)
    demand: dict[int, int] = {}
    size = room = 0
    for n in sorted(large, reverse=True):
        c = large[n]
        while c:
            if not room:
                size, room = n, share
            t = min(c, room)
            demand[size] = demand.get(size, 0) + t
            c, room = c - t, room - t
    return demand


def _substitute(large: dict[int, int], lengths: list[int], slots: list[int], times: int, capacity: int) -> list[tuple[int, list[int]]]:
    """Up to ``times`` sequences of actual lengths in these slots, in runs of equal ones; ``lengths`` are those of ``large``, ascending."""
    out: list[tuple[int, list[int]]] = []
    while times:
        used: dict[int, int] = {}
        taken: list[int] = []
        room = capacity
        for i, size in enumerate(slots):
            j = bisect.bisect_right(lengths, min(size, room) if i + 1 < len(slots) else room) - 1
            while j >= 0 and large[lengths[j]] == used.get(lengths[j], 0):
                j -= 1
            if j < 0:  # later slots are no longer, so they stay empty too
                break
            taken.append(lengths[j])
            used[lengths[j]] = used.get(lengths[j], 0) + 1
            room -= lengths[j]
        if not taken:
            break
        k = min(times, *(large[n] // u for n, u in used.items()))
        for n, u in used.items():
            large[n] -= u * k
            if not large[n]:
                del large[n]
                lengths.remove(n)
        out.append((k, taken))
        times -= k
    return out


def _best_fit(runs: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Put what is left, largest first, where it leaves least room; open new sequences only when nothing fits."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for times, lengths in runs:
        by_room.setdefault(capacity - sum(lengths), []).append((times, lengths))
    rooms = sorted(by_room)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                fit = capacity // n
                if c >= fit:
                    times, held = c // fit, fit
                else:
                    times, held = 1, c
                new, room = (times, [n] * held), capacity - n * held
                c -= times * held
            else:
                r = rooms[i]
                times, lengths = by_room[r].pop()
                each = min(r // n, c)
                k = min(times, c // each)
                if times > k:
                    by_room[r].append((times - k, lengths))
                if not by_room[r]:
                    del by_room[r]
                    rooms.pop(i)
                new, room = (k, lengths + [n] * each), r - n * each
                c -= k * each
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(new)
    return [run for r in sorted(by_room) for run in by_room[r]]


def slots(runs: list[tuple[int, list[int]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Per length: first ranks, and for each the first sequence and the offset there. Rank r in a run gets sequence first + r - rank."""
    ranks: dict[int, int] = {}
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    first = 0
    for times, lengths in runs:
        at = 0
        for n in lengths:
            rank, seq, off = out.setdefault(n, ([], [], []))
            rank.append(ranks.get(n, 0))
            seq.append(first)
            off.append(at)
            ranks[n] = ranks.get(n, 0) + times
            at += n
        first += times
    return out


def pack(parts: DataFrame, capacity: int, length_col: str = "length", tie_cols: tuple[str, ...] = ("doc_id", "piece"), groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to ``capacity``: places in as few sequences as the plan finds.

    ``parts`` must give the same rows when read again (a written table). The driver sees at most ``capacity`` counts
    and the tasks get at most some thousand runs. Rows whose length is null or out of range raise an error.
    Equal rows are places of their own; no rows give none. Columns named sequence_id and offset are replaced.
    """
    parts = parts.drop("sequence_id", "offset")
    total, fit = parts.agg(F.count("*"), F.count_if(F.col(length_col).between(1, capacity))).first()
    if total != fit:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    buckets = max(BUCKETS, total // IN_BUCKET)
    bucket, rank, base, count = (free_name(parts.columns, x) for x in ("bucket", "rank", "base", "count"))
    dealt = parts.withColumn(bucket, F.pmod(F.xxhash64(*tie_cols), F.lit(buckets)).cast("int"))
    per = materialise(dealt.groupBy(F.col(length_col).alias("l"), F.col(bucket).alias("b")).agg(F.count("*").alias(count)), "lengths")
    histogram = {r["l"]: r["c"] for r in per.groupBy("l").agg(F.sum(count).alias("c")).collect()}
    places = slots(plan(histogram, capacity, groups, small))
    lookup = {n: tuple(np.array(x, np.int64) for x in v) for n, v in places.items()}

    @F.pandas_udf("seq bigint, off int")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
        by = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[by], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(n)], strict=True):
            at = by[a:z]
            firsts, seqs, offs = lookup[int(n[at[0]])]
            i = np.searchsorted(firsts, r[at], side="right") - 1
            seq[at] = seqs[i] + r[at] - firsts[i]
            off[at] = offs[i]
        return pd.DataFrame({"seq": seq, "off": off})

    before = Window.partitionBy("l").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("l", "b", F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(length_col, bucket).orderBy(*tie_cols)
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1)
    ranked = ranked.join(bases, (F.col(length_col) == F.col("l")) & (F.col(bucket) == F.col("b"))).drop("l", "b")
    spot = free_name(parts.columns, "spot")
    ranked = ranked.withColumn(spot, place(F.col(length_col), F.col(base) + F.col(rank)))
    return ranked.select(*parts.columns, F.col(f"{spot}.seq").alias("sequence_id"), F.col(f"{spot}.off").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str, text_col: str, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(materialise(pieces(docs, id_col, text_col, capacity, end_id, tokenizer_path), "pieces"), capacity)
