"""Target-distribution importance resampling over hashed word n-grams.

Texts are compared with a target by the counts of features in buckets. A feature's bucket is its crc32, and crc32 is linear up to a constant that
depends on the length alone: the checksum is the XOR of what each byte contributes at its distance from the end, and of that constant. So a table of
contributions by distance and byte value gives the checksums of all features of a batch by one gather and one ``bitwise_xor.reduceat`` over their
spans, without touching any feature by itself. Spans longer than the table are folded from blocks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Distances from the end in the table of contributions; longer spans are cut into blocks of so many bytes.
REACH = 64
#: Bytes of text hashed at once.
CHUNK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _constant(size: int) -> int:
    """The checksum of so many zero bytes: what every text of that length has beside its bytes' contributions."""
    return zlib.crc32(bytes(size))


def contributions(reach: int) -> np.ndarray:
    """(reach, 256): what a byte value adds to a checksum at each distance from the end. Distance 0 by definition, each further one a zero byte later."""
    step = np.array([zlib.crc32(bytes([b])) ^ _constant(1) for b in range(256)], np.uint32)
    table = np.empty((reach, 256), np.uint32)
    table[0] = step
    for d in range(1, reach):
        table[d] = step[table[d - 1] & 0xFF] ^ (table[d - 1] >> np.uint32(8))
    return table


def later(zeros: np.ndarray) -> np.ndarray:
    """The step over twice as many zero bytes, as (4, 256) tables by the bytes of a register, from the step over some."""
    return np.stack([over(zeros[k], zeros) for k in range(4)])


def over(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that the (4, 256) tables stand for."""
    return zeros[0][register & 0xFF] ^ zeros[1][(register >> 8) & 0xFF] ^ zeros[2][(register >> 16) & 0xFF] ^ zeros[3][register >> 24]


class Checksums:
    """crc32 of many spans of a byte buffer."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.table = contributions(reach).ravel()
        self.constants = np.array([_constant(n) for n in range(reach + 1)], np.uint32)
        base = np.zeros((4, 256), np.uint32)
        step = contributions(1)[0]
        for k in range(4):
            reg = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(reach):
                reg = step[reg & 0xFF] ^ (reg >> np.uint32(8))
            base[k] = reg
        self.block = base

    def _short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of contributions of rising spans without overlaps, none longer than the table reaches. A byte follows the last span."""
        sizes = ends - starts
        back = np.zeros(len(data), np.int64)
        inside = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
        back[inside] = np.repeat(ends, sizes) - 1 - inside
        parts = self.table[back * 256 + data]
        edges = np.stack([starts, ends], axis=1).ravel()
        return np.bitwise_xor.reduceat(parts, edges)[::2]

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """crc32 of rising, non-empty spans without overlaps; a further byte must follow each."""
        if not len(starts):
            return np.empty(0, np.uint32)
        sizes = ends - starts
        if sizes.max() <= self.reach:
            return self._short(data, starts, ends) ^ self.constants[sizes]
        out = np.empty(len(starts), np.uint32)
        short = sizes <= self.reach
        if short.any():
            out[short] = self._short(data, starts[short], ends[short]) ^ self.constants[sizes[short]]
        for i in np.flatnonzero(~short).tolist():  # words of more than REACH bytes are rare
            out[i] = self._long(data[starts[i] : ends[i] + 1])
        return out

    def _long(self, data: np.ndarray) -> int:
        """Of one span and a further byte: blocks from the end, then pairs of blocks, pairs of pairs, and so on."""
        size = len(data) - 1
        ends = np.arange(size, 0, -self.reach)[::-1]
        regs = self._blocks(data, np.maximum(ends - self.reach, 0), ends)[::-1]  # the last block first
        zeros = self.block
        while len(regs) > 1:
            if len(regs) % 2:
                regs = np.append(regs, np.uint32(0))  # zero bytes before the text add nothing
            regs = regs[0::2] ^ over(regs[1::2], zeros)
            zeros = later(zeros)
        return int(regs[0]) ^ _constant(size)

    def _blocks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of contributions of blocks that follow each other without a gap."""
        sizes = ends - starts
        back = np.repeat(ends, sizes) - 1 - np.arange(starts[0], ends[-1])
        return np.bitwise_xor.reduceat(self.table[back * 256 + data[starts[0] : ends[-1]]], starts - starts[0])


def feature_buckets(texts: pa.Array, buckets: int, sums: Checksums) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, words of each text, text of each feature, bucket of each feature) of runs of texts of about ``CHUNK`` bytes.

    Words are runs of letters and digits of ASCII, with A-Z in lower case, and of all other code points; features are words and pairs of neighbours.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        raw, edge = _LOWER[data[offs[a] : offs[z]]], offs[a : z + 1] - offs[a]
        word = _WORD[raw]
        begins = np.zeros(len(raw) + 1, bool)
        begins[edge] = True
        first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]) | word & begins[:-1]) if len(raw) else np.empty(0, np.int64)
        last = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | begins[1:])) + 1 if len(raw) else first
        of = np.searchsorted(edge, first, "right") - 1
        n = np.bincount(of, minlength=z - a)
        # one buffer of all words with a space behind each
        sizes = last - first
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        line = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        here = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        line[here] = raw[word]
        pair = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.empty(0, np.int64)
        even, odd = pair[pair % 2 == 0], pair[pair % 2 == 1]
        owner = np.concatenate([of, of[even], of[odd]])
        crc = np.concatenate([sums.of(line, starts[i], ends[j]) for i, j in ((slice(None), slice(None)), (even, even + 1), (odd, odd + 1))])
        yield a, z, n, owner, (crc % np.uint32(buckets)).astype(np.int64)
        a = z


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts. A task sends one row for each bucket it met; a null text has no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = Checksums(), np.zeros(buckets, np.int64)
        for b in batches:
            for *_, found in feature_buckets(b.column(0), buckets, sums):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _held(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts as an array: ``buckets`` numbers, a parameter, whatever the size of the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln) of how much likelier the target has it, both smoothed by one."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: str) -> int:
    """A draw of the Gumbel distribution in thousandths, rounded down, from the first 32 bits of the sha256 of a text."""
    h = int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_rows(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight, score. The weight is the mean gain of the features, rounded down (0 without any); the score adds a Gumbel draw."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for b in batches:
            ids = b.column("id").to_pylist()
            for a, z, words, owner, found in feature_buckets(b.column("text"), buckets, sums):
                n = np.bincount(owner, minlength=z - a)
                total = np.bincount(owner, weights=gain[found], minlength=z - a).astype(np.int64)  # integers below 2**53: exact
                weight = total // np.maximum(n, 1)
                score = weight + np.array([gumbel(f"{seed}:{'' if i is None else i}") for i in ids[a:z]], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, z - a), *(pa.array(c, pa.int64()) for c in (words, n, weight, score))], ["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, wanted: int, order: list, least: str, name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in this order among those where ``least`` holds, up to ``wanted``; null beyond. No task sees more than its range."""
    told = numbered(rows.where(least), order, name).withColumn(name, F.when(F.col(name) < wanted, F.col(name) + 1))
    rest = rows.where(~F.coalesce(F.expr(least), F.lit(False))).withColumn(name, F.lit(None).cast("long"))
    return told.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every row: ``share`` in 100 of those with ``least_words`` are drawn without replacement,
    likelier the more their features are the target's (Gumbel top-k), and ranked by score, then id, from 1; others have no rank.

    Two passes over the texts, one over the target. Null and blank texts have no features, weight 0 and no rank. Null ids draw as an empty id and come
    first among ties; rows that repeat an id draw alike and are ranked one after the other. Without a target or documents all gains are of empty counts.
    Other columns are not read. The driver holds two arrays of ``buckets`` counts, and a count for each task of the sort.
    """
    gain = gains(_held(bucket_counts(docs, text_col, buckets), buckets), _held(bucket_counts(target, target_col, buckets), buckets))
    rows = materialise(score_rows(docs, id_col, text_col, gain, seed), "scores")
    n = rows.where(F.col("n_words") >= least_words).count()
    return ranked(rows, share * n // 100, [F.desc("score"), F.asc("id")], f"n_words >= {least_words}")
