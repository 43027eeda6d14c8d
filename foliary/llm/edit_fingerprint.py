"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text character by character and repeats each a random number of times: at output place j
the character c is written, and the walk moves on if the shared bit h(j, c) is one. Texts that differ by few edits
fall back into step, so edit distance becomes Hamming distance between outputs. The fingerprint samples the
output at the places of least shared random priority below its length: samples of two lengths are nested, so
any two fingerprints compare. Bands of sampled places find candidates; exact edit distance verifies them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UnionFind, block_pairs, groups, materialise, mix64
from .graph import components

SAMPLES = 256
PERIOD = 4096
SEED = 5
#: Likeness below which two texts are not compared exactly: of 150 texts with every tenth character edited none was below 0.1.
MARGIN = 0.08
_BATCH = 2_000_000  # characters walked together


@functools.cache
def _steps() -> np.ndarray:
    """(256 * PERIOD) places from j to the next place where the bit of a character class is one."""
    bits = np.random.default_rng(SEED).integers(0, 2, (256, PERIOD), np.uint8)
    bits[:, 0] = 1
    twice = np.concatenate([bits, bits], axis=1)
    out = np.zeros((256, 2 * PERIOD), np.int64)
    run = np.zeros(256, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        run = np.where(twice[:, j] == 1, 0, run + 1)
        out[:, j] = run
    return np.ascontiguousarray(out[:, :PERIOD]).reshape(-1)


@functools.cache
def _by_priority(level: int) -> np.ndarray:
    """Places below 2**level, least priority first."""
    j = np.arange(1 << level, dtype=np.uint64)
    return np.argsort(mix64(j + np.uint64(SEED << 40)), kind="stable")


@functools.lru_cache(4096)
def sample_places(length: int, m: int = SAMPLES) -> np.ndarray:
    """The ``m`` places below ``length`` of least priority, ascending (all if there are no more)."""
    if length <= m:
        return np.arange(length)
    p = _by_priority((length - 1).bit_length())
    for k in (3 * m, len(p)):
        s = p[:k]
        s = s[s < length]
        if len(s) >= m:
            break
    return np.sort(s[:m])


def char_classes(text: str) -> np.ndarray:
    """Code points as classes 0..255; ASCII and Latin-1 characters have one each, others are hashed."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 256, c, mix64(c.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def walk(texts: Sequence[np.ndarray], begin: Sequence[int]) -> list[np.ndarray]:
    """For each text the output place of every character, and last the place after all; from ``begin`` on."""
    steps = _steps()
    sizes = np.array([len(t) for t in texts], np.int64)
    by = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([texts[i] for i in by] or [np.empty(0, np.uint8)]).astype(np.int64) << 12
    ends = np.cumsum(sizes[by])
    base = ends - sizes[by]
    path = np.empty(len(flat), np.int64)
    j = np.array([begin[i] for i in by], np.int64)
    top = sizes[by]
    active, i = len(by), 0
    while True:
        while active and top[active - 1] <= i:
            active -= 1
        if active < 24:
            break
        at = base[:active] + i
        here = j[:active]
        path[at] = here
        here += steps[flat[at] | (here & (PERIOD - 1))] + 1
        i += 1
    if active:
        small = _steps_bytes()
        for d in range(active):  # few long texts: a plain loop is faster than short vectors
            x, places = int(j[d]), []
            for c in flat[base[d] + i : ends[d]].tolist():
                places.append(x)
                x += small[c | (x & 4095)] + 1
            path[base[d] + i : ends[d]] = places
            j[d] = x
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(by)
    for k, t in enumerate(by.tolist()):
        out[t] = np.append(path[base[k] : ends[k]], j[k])
    return out


@functools.cache
def _steps_bytes() -> bytes:
    return np.minimum(_steps(), 255).astype(np.uint8).tobytes()


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)[(mix64(np.arange(256, dtype=np.uint64)) & np.uint64(15)).astype(int)]


def fingerprint(classes: np.ndarray, path: np.ndarray) -> str:
    """Output length in hex, a colon, and a hex digit of the character at each sampled place."""
    n = int(path[-1]) if len(path) else 0
    at = np.searchsorted(path[:-1], sample_places(n), side="right") - 1
    return f"{n:x}:{_HEX[classes[at]].tobytes().decode()}"


def likeness(a: str, b: str) -> float:
    """Share of the sampled places of the longer output where both have the same digit; 1 for two empty texts."""
    (n, x), (m, y) = ((int(h, 16), s) for h, _, s in (a.partition(":"), b.partition(":")))
    if n > m:
        n, m, x, y = m, n, y, x
    if not m:
        return 1.0
    if n == m:
        same = np.frombuffer(x.encode(), np.uint8) == np.frombuffer(y.encode(), np.uint8)
        return float(same.mean())
    longer, shorter = sample_places(m), sample_places(n)
    both = longer < n
    u = np.frombuffer(y.encode(), np.uint8)[both]
    v = np.frombuffer(x.encode(), np.uint8)[np.searchsorted(shorter, longer[both])] if n else u[:0]
    return float((u == v).sum() / len(longer))


def _edited(text: str, after: str) -> tuple[int, str]:
    k = len(text) // 4
    return k, text[: len(text) - k] + after[:k]


def digest_pairs(rows: Sequence[tuple[int | None, str, str | None]]) -> list[tuple]:
    """For rows (id, text, next text): id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The walk of an edited text shares the kept beginning with the text's own. Where rows follow each other, so do
    their texts, and each is walked once.
    """
    texts: list[str] = []
    own: list[int] = []
    nxt: list[int] = []
    for i, (_, t, after) in enumerate(rows):
        if i and rows[i - 1][2] is t:
            own.append(len(texts) - 1)
        else:
            own.append(len(texts))
            texts.append(t)
        nxt.append(len(texts))
        texts.append(after or "")
    classes = [char_classes(t) for t in texts]
    paths = walk(classes, [0] * len(texts))
    prints = [fingerprint(c, p) for c, p in zip(classes, paths, strict=True)]
    tails, begin = [], []
    for (_, t, _a), o, x in zip(rows, own, nxt, strict=True):
        k = len(t) // 4
        tails.append(classes[x][:k])
        begin.append(int(paths[o][len(t) - k]))
    ends = walk(tails, begin)
    out = []
    for (key, t, after), o, x, tail, end in zip(rows, own, nxt, tails, ends, strict=True):
        k, edited = _edited(t, after or "")
        c = np.concatenate([classes[o][: len(t) - k], tail])
        p = np.concatenate([paths[o][: len(t) - k], end])
        f = fingerprint(c, p)
        out.append((key, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), prints[o], f, likeness(prints[o], f), likeness(prints[o], prints[x])))
    return out


_COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], extra: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
    arrays = [pa.array(c, t) for c, t in zip(cols, _COLUMNS.values(), strict=True)] + [pa.array(v, t) for t, v in extra.values()]
    return pa.RecordBatch.from_arrays(arrays, [*_COLUMNS, *extra])


def fingerprint_with_edits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, and the likeness to the next document's.

    Ascending id, null ids first, equal ids by a hash of the text; the last document is followed by the first. Null texts are empty. The rows are
    range-partitioned and sorted once; each task streams its range. Only the last row of a range, whose
    successor is elsewhere, is finished by a join of one row per range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = prev = None
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple], first=None, last=None) -> pa.RecordBatch:
            done = digest_pairs(rows)
            marks = [None] * len(done)
            texts: list = [None] * len(done)
            for mark, row in (("first", first), ("last", last)):
                if row:
                    done.append((row[0], *[None] * 6))
                    marks.append(mark)
                    texts.append(row[1])
            return _batch(done, {"part": (pa.int64(), [part] * len(done)), "mark": (pa.string(), marks), "text": (pa.string(), texts)})

        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if prev:
                    held.append((*prev, text))
                    size += len(prev[1])
                first = first or (key, text)
                prev = (key, text)
                if size >= _BATCH:
                    yield out(held)
                    held, size = [], 0
        if prev:
            yield out(held, first, prev)

    done = materialise(rows.mapInArrow(run, f"{_DDL}, part bigint, mark string, text string"), "prints")
    edge = done.where("mark is not null").select("part", "mark", F.col("doc_id").alias("id"), "text")
    parts = edge.where("mark = 'first'").select("part")
    line = Window.orderBy("part")  # one row per range
    follow = parts.select("part", F.lead("part").over(line).alias("after")).withColumn("after", F.coalesce("after", F.lit(parts.agg(F.min("part")).first()[0])))
    last = edge.where("mark = 'last'").drop("mark").join(follow, "part").select("id", "text", "after")
    heads = edge.where("mark = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(digest_pairs(list(zip(*(b.column(c).to_pylist() for c in ("id", "text", "next_text")), strict=True))), {})

    fixed = last.join(heads, "after").select("id", "text", "next_text").mapInArrow(finish, _DDL)
    return done.where("mark is null").select(*_COLUMNS).unionByName(fixed)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, all cells of a column at once in one integer."""
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    for c in b:
        e = eq.get(c, 0)
        d0 = (((e & up) + up) ^ up) | e | down
        right = down | ~(d0 | up) & mask
        left = up & d0
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & mask
        up = (left << 1 | ~(d0 | right)) & mask
        down = right & d0
    return score


def bands(classes: np.ndarray, path: np.ndarray, count: int, width: int) -> list[int]:
    """Hashes of ``count`` bands of ``width`` sampled places, at the two powers of two at or below the output length."""
    n = int(path[-1])
    out = []
    top = max(n, 1).bit_length() - 1
    for level in {top, max(top - 1, 0)}:
        p = _by_priority(level)[: count * width]
        p = p[p < n]
        if not len(p):
            p = np.zeros(0, np.int64)
        c = classes[np.searchsorted(path[:-1], p, side="right") - 1] if n else np.empty(0, np.uint8)
        for i in range(count):
            raw = bytes([level, i]) + c[i * width : (i + 1) * width].tobytes()
            out.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
    return out


def window_bands(texts: Sequence[np.ndarray], count: int, width: int = 16, places: int = 40, run: int = 8) -> list[list[int]]:
    """For each text, hashes of ``width`` sampled places of walks that begin anew at up to ``count`` anchors of the text.

    Anchors are where the runs of ``run`` characters of least hash occur first, so that texts with common passages share them. A walk
    over a whole text falls out of step after many edits; these see about ``places / 2`` characters each and forget what came before.
    """
    windows, of = [], []
    for t, c in enumerate(texts):
        if len(c) >= run:
            runs = mix64(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c, run)).view(np.uint64).reshape(-1))
            _, first = np.unique(runs, return_index=True)
            for i in first[:count].tolist():
                windows.append(c[i : i + places])
                of.append(t)
    sampled = np.sort([p for p in _by_priority(places.bit_length()).tolist() if p < places][:width])
    out: list[list[int]] = [[] for _ in texts]
    for t, c, path in zip(of, windows, walk(windows, [0] * len(windows)), strict=True):
        raw = b"w" + c[np.searchsorted(path[:-1], sampled, side="right") - 1].tobytes()
        out[t].append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
    return out


def edit_groups(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.9, count: int = 16, width: int = 8, anchors: int = 64, cap: int = 256) -> DataFrame:
    """id, component_id of documents linked by edit similarity 1 - distance / longer length >= ``similarity``.

    Equal texts are one class (null texts are empty ones, and one class too); repeated rows are rows of their own, and no rows give none.
    Other columns are not read. Classes that share a band of sampled places, of the walk over the whole text or of one from an anchor, are
    compared: first by fingerprints, with a margin, then exactly. Large buckets are split into pairs of blocks. component_id is the smallest
    id reachable, null only if all of a group are. Of texts of 200 characters and more with scattered edits at least 0.9 are found at
    each similarity from 0.9 up (see the test); shorter ones at 0.9 to 0.95 may be missed more often.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    one = rows.groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            classes = [char_classes(t) for t in texts]
            paths = walk(classes, [0] * len(texts))
            prints = [fingerprint(c, p) for c, p in zip(classes, paths, strict=True)]
            keys = [bands(c, p, count, width) + w for c, p, w in zip(classes, paths, window_bands(classes, anchors), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], ["key", "text", "print", "bands"])

    prints = materialise(one.mapInArrow(run, "key string, text string, print string, bands array<bigint>"), "bands")
    posts = prints.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = posts.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    tasks = block_pairs(posts.join(sizes, "band"), "band", "c", F.xxhash64("key"), cap).join(prints.drop("bands"), "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["band", "blk_a", "blk_b"]):
            keys, texts, fps, side = (t.column(c).to_pylist() for c in ("key", "text", "print", "blk"))
            uf, found = UnionFind(len(keys)), []
            both = len(set(side)) > 1
            for i in range(len(keys)):
                for j in range(i + 1, len(keys)):
                    longer = max(len(texts[i]), len(texts[j]))
                    if (both and side[i] == side[j]) or uf.find(i) == uf.find(j) or abs(len(texts[i]) - len(texts[j])) > (1 - similarity) * longer:
                        continue
                    # an edit may put walks out of step for a while: the likeness bound is loose
                    if likeness(fps[i], fps[j]) >= MARGIN and edit_distance(texts[i], texts[j]) <= (1 - similarity) * longer:
                        uf.join(i, j)
                        found.append((keys[i], keys[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], ["a", "b"])

    order = ["band", "blk_a", "blk_b"]
    edges = tasks.select(*order, "blk", "key", "text", "print").repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "a string, b string")
    comp = components(materialise(edges, "edits")).withColumnRenamed("node", "key")
    of = rows.select("id", "key").join(comp, "key", "left").select("id", F.coalesce("root", "key").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")
