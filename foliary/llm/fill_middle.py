"""Fill-in-the-middle texts, cut with a learned index from code points to bytes.

UTF-8 gives no way to jump to the n-th code point. Here the offsets of all code point boundaries of a batch are one rising sequence, which
piecewise-linear segments approximate within ``ERROR`` bytes. A segment predicts the offset of any boundary, and the stored residual of a byte
corrects the prediction exactly, so a cut is found without decoding or walking the text. Texts stay bytes all the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest distance of a boundary from its segment's line before rounding; residuals fit into a signed byte.
ERROR = 100
#: Bytes indexed at once; boundaries of more are never held as integers. A batch of output has about eight times as many.
PIECE = 1 << 20
MARKS = ("<P>", "<S>", "<M>")


def fit_segments(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """(starts, slopes) of lines through (start, y[start]) that stay within ``error`` of y up to the next start.

    A segment goes on while some slope suits all its points: the largest lower and the smallest upper bound so far narrow to a cone, whose middle is
    taken. The bounds are running extremes of whole windows, which double as long as the segment lasts.
    """
    starts, slopes = [], []
    n, at = len(y), 0
    while at < n:
        low, high, end, width = -np.inf, np.inf, at + 1, 512
        while end < n:
            stop = min(n, end + width)
            dx = np.arange(end - at, stop - at, dtype=np.float64)
            dy = (y[end:stop] - y[at]).astype(np.float64)
            lows = np.maximum(np.maximum.accumulate((dy - error) / dx), low)
            highs = np.minimum(np.minimum.accumulate((dy + error) / dx), high)
            fits = len(dx) if lows[-1] <= highs[-1] else int(np.argmax(lows > highs))
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            width *= 2
            if fits < len(dx):
                break
        starts.append(at)
        slopes.append((low + high) / 2 if end > at + 1 else 1.0)
        at = end
    return np.array(starts, np.int64), np.array(slopes)


class RankIndex:
    """Byte offsets of the code points of a buffer, by rank; and the ranks at given offsets, which must be rising.

    It keeps a few numbers for each segment and one byte for each code point. Bytes that are no valid UTF-8 count as code points of their own unless
    they look like continuations.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, error: int = ERROR, piece: int = PIECE):
        starts, anchors, slopes, rests = [], [], [], []
        self.ranks = np.zeros(len(offsets), np.int64)
        rank = 0
        for a in range(0, len(data) + 1, piece):
            z = min(a + piece, len(data))
            some = np.flatnonzero((data[a:z] & 0xC0) != 0x80) + a
            if z == len(data) and z - a < piece:
                some = np.append(some, z)  # the boundary behind the last code point
            here = slice(*np.searchsorted(offsets, [a, z + (z - a < piece)]))
            self.ranks[here] = rank + np.searchsorted(some, offsets[here])
            if not len(some):
                continue
            s, k = fit_segments(some, error)
            of = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(some))))
            line = some[s][of] + np.rint(k[of] * (np.arange(len(some)) - s[of])).astype(np.int64)
            rests.append((some - line).astype(np.int8))
            starts.append(s + rank)
            anchors.append(some[s])
            slopes.append(k)
            rank += len(some)
        self.starts, self.anchors, self.slopes, self.rests = map(np.concatenate, (starts, anchors, slopes, rests))

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Where the code points of these ranks begin: the segments' predictions, corrected by residuals."""
        of = np.searchsorted(self.starts, rank, "right") - 1
        return self.anchors[of] + np.rint(self.slopes[of] * (rank - self.starts[of])).astype(np.int64) + self.rests[rank]


def rearranged(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, form: np.ndarray, marks: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(from, to, n, prefix, middle, outputs) of runs of texts of about ``8 * PIECE`` bytes. ``form``: 0 plain, 1 psm, 2 spm; empty texts are plain."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    every = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    p, s, m = marks
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(every, every[a] + 8 * PIECE, "right")) - 1)
        some, offs = data[every[a] : every[z]], every[a : z + 1] - every[a]
        index = RankIndex(some, offs)
        n = np.diff(index.ranks)
        cut = np.sort(np.stack([h1[a:z] % (n + 1), h2[a:z] % (n + 1)]), axis=0)
        c1, c2 = (index.offset(index.ranks[:-1] + c) for c in cut)
        whole, out = some.tobytes(), []
        for f, lo, x, y, hi in zip(form[a:z].tolist(), offs[:-1].tolist(), c1.tolist(), c2.tolist(), offs[1:].tolist(), strict=True):
            if f == 0 or lo == hi:
                out.append(whole[lo:hi])
            elif f == 1:
                out.append(b"".join((p, whole[lo:x], s, whole[y:hi], m, whole[x:y])))
            else:
                out.append(b"".join((s, whole[y:hi], p, whole[lo:x], m, whole[x:y])))
        yield a, z, n, cut[0], cut[1] - cut[0], out
        a = z


def fill_in_middle(docs: DataFrame, id_col: str, text_col: str, seed: int = 1, plain: int = 10, spm: int = 20, marks: Sequence[str] = MARKS) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output: every text as prefix, suffix and middle, cut at two code points drawn from its id.

    The draws are the first four 8-digit groups of sha256("seed:id"). ``plain`` in 100 texts stay as they are, as do empty ones and those that hold one of
    ``marks``; of the others ``spm`` in 100 have the suffix first. Both cuts of a plain text are null. A null text is empty; a null id draws as
    an empty one; repeated ids draw alike; other columns are not read. A task holds a batch of texts and its outputs, and nothing is shuffled.
    """
    text = F.col(text_col)
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    held = F.lit(False)
    for x in marks:
        held |= F.contains(text, F.lit(x))
    stays = F.coalesce(held, F.lit(True)) | (text == "") | (draw[2] % 100 >= 100 - plain)
    form = F.when(stays, 0).when(draw[3] % 100 < spm, 2).otherwise(1).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), draw[0].alias("h1"), draw[1].alias("h2"), form.alias("form"))
    raw = [x.encode() for x in marks]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, kind = (b.column(c).to_numpy() for c in ("h1", "h2", "form"))
            for a, z, n, prefix, middle, out in rearranged(b.column("text"), h1, h2, kind, raw):
                is_plain = kind[a:z] == 0
                wide = pa.array(out, pa.large_binary())
                texts = pa.Array.from_buffers(pa.large_string(), len(wide), wide.buffers())
                forms = pa.DictionaryArray.from_arrays(pa.array(kind[a:z], pa.int32()), pa.array(["plain", "psm", "spm"])).cast(pa.string())
                cols = [b.column("id").slice(a, z - a), pa.array(n), forms, pa.array(prefix, mask=is_plain), pa.array(middle, mask=is_plain), texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text of an output: the parts between its marks in their old order. Null for an unknown form."""
    p, s, m = map(F.lit, marks)
    after = lambda mark, end: F.split_part(F.split_part(output, mark, F.lit(2)), end, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(after(p, s), middle, after(s, m))).when(form == "spm", F.concat(after(p, m), middle, after(s, p)))


def digest(made: DataFrame) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of the rows of ``fill_in_middle`` with the default marks."""
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))
