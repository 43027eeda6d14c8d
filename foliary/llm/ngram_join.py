"""N-gram Jaccard join with a prefix tree.

Every text is the set of its k-word shingles. Equal sets form one class. Sets are ordered by one global order:
rare tokens first, by the counts of all documents, ties by hash. Two sets can reach Jaccard t only if they share one of
their first |x| - ceil(t|x|) + 1 tokens, so each such token that two classes share opens a bucket. In a bucket the
whole ordered sets are stored in a trie; a traversal shares the overlap of common beginnings and prunes
subtrees whose remaining lengths cannot reach the bound. Only edges of a spanning forest leave a bucket.

Near copies share many tokens, so their buckets hold much the same classes. The largest bucket of each class comes first. What may still link
across the components found is sent once per chain of overlapping buckets, where that is less than once per bucket.

Texts travel, not sets: a word takes fewer bytes than its token, and tasks make the sets anew. Only texts that a task asks for are shuffled: a
bounded filter of bits leaves out most others where they are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shingler, UnionFind, attach, block_pairs, free_name, groups, materialise, session_conf, slices
from .graph import components

#: Most tokens whose counts every task holds (12 MB). Beyond it, only larger counts are told apart, which
#: changes the order of tokens, and so the work, but no result.
RANKED = 1 << 20
#: Classes of a bucket that meet in one task; larger buckets are split into pairs of blocks.
CAP = 400
#: Bits of the filter of the rows that are asked for (8 MB).
SIFT = 1 << 26
#: Tokens in one trie node, so that long tails are cut early.
SEGMENT = 256


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens that must be indexed so that sets with Jaccard >= num/den share one: n - ceil(n*num/den) + 1."""
    return n - (-(-n * num // den)) + 1


def token_counts(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(tok, c) for tokens that occur more than once among the first tokens by hash, of all rows.

    Half as many tokens again as must be indexed are counted, so that those which move up are known too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            toks, c = np.unique(np.concatenate([s[: 3 * prefix_length(len(s), num, den) // 2] for s in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(toks.view(np.int64)), pa.array(c)], ["tok", "n"])

    return docs.select("text").mapInArrow(run, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("c")).where("c > 1")


def ranks(counts: DataFrame, most: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, sorted, and their counts: those above the least of 1, 2, 4, ... that leaves at most ``most``."""
    above = 1
    while counts.where(F.col("c") > above).count() > most:
        above *= 2
    got = counts.where(F.col("c") > above).toArrow()
    toks = got.column("tok").to_numpy().view(np.uint64)
    by = np.argsort(toks)
    return toks[by], np.minimum(got.column("c").to_numpy(), (1 << 32) - 1).astype(np.uint32)[by]


def in_order(sets: list[np.ndarray], known: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Sets that are sorted by hash in the global order: by ``count`` of the tokens ``known``, then by hash."""
    flat = np.concatenate(sets)
    at = np.searchsorted(known, flat)
    at[at == len(known)] = 0
    c = np.where(known[at] == flat, count[at], 0) if len(known) else np.zeros(len(flat), np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    return [s[np.argsort(c[e - len(s) : e], kind="stable")].view(np.int64) for s, e in zip(sets, ends, strict=True)]


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    import xxhash

    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def set_table(docs: DataFrame, k: int, num: int, den: int, order) -> DataFrame:
    """rid, id, key (16-byte digest of the shingle set), n (its size) and toks: those to index, in global order.

    Needs columns rid, id and text. Rows without words have n = 0 and a null key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            keys, ns = set_keys(sets), [len(s) for s in sets]
            sets = [s[: prefix_length(n, num, den)] for s, n in zip(in_order(sets, *order.value), ns, strict=True)]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), toks], ["rid", "id", "key", "n", "toks"])

    return docs.select("rid", "id", "text").mapInArrow(run, "rid bigint, id bigint, key binary, n int, toks array<bigint>")


def sifted(rows: DataFrame, col: str, wanted: DataFrame, bits: int = SIFT, then: tuple | None = None) -> DataFrame:
    """The rows whose ``col`` (a number or null) is in that of ``wanted``, and some others: those that share its bit. Nothing is shuffled but bits.

    ``then`` is a function of record batches and its schema, through which the rows go on in the same Python worker.
    """
    further, schema = then or (iter, rows.schema)
    place = F.pmod(F.xxhash64(col), F.lit(bits))
    words = wanted.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")).toArrow()
    mask = np.zeros(bits // 64, np.uint64)
    mask[words.column("w").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
    mask = rows.sparkSession.sparkContext.broadcast(mask)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column(b.num_columns - 1).to_numpy().astype(np.uint64)
            held = mask.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)
            yield b.select(range(b.num_columns - 1)).filter(pa.array(held.astype(bool)))

    return rows.withColumn(free_name(rows.columns, "bit"), place).mapInArrow(lambda batches: further(kept(batches)), schema)


def text_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """no, key and text of the rows of ``docs`` (id, text) that have words and an id of ``ids``, and of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in slices(batches, "text"):
            keys = pa.array(set_keys(shingler.sets(batch.column("text"))), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, batch.column("text")], ["key", "text"]).filter(keys.is_valid())

    return sifted(docs.select("id", "text"), "id", ids, then=(run, "key binary, text string")).select(F.monotonically_increasing_id().alias("no"), "key", "text")


class _Node:
    """Tokens ``seg`` after those of the parent; below it are the sets at lo..hi-1 of the sorted order."""

    __slots__ = ("deepest", "ends", "hi", "kids", "least", "lo", "one", "seg")

    def __init__(self, seg: tuple[int, ...], lo: int, hi: int):
        self.seg, self.lo, self.hi, self.kids, self.ends, self.one = seg, lo, hi, [], 0, hi - lo == 1
        self.least, self.deepest = 1 << 60, 0


def _trie(sets: list[tuple[int, ...]], lo: int, hi: int, depth: int) -> _Node:
    """Trie over sets[lo:hi], which are sorted and equal before ``depth``; nodes hold up to SEGMENT tokens.

    Long sets make deep tries, so open nodes are on a stack of its own.
    """
    made: list[_Node] = []
    stack: list[tuple[int, int, int, _Node | None]] = [(lo, hi, depth, None)]
    while stack:
        lo, hi, depth, parent = stack.pop()
        first, last = sets[lo], sets[hi - 1]
        end, top = depth, min(len(first), len(last), depth + SEGMENT)
        while end < top and first[end] == last[end]:
            end += 1
        node = _Node(first[depth:end], lo, hi)
        made.append(node)
        if parent:
            parent.kids.append(node)
        i = lo
        while i < hi and len(sets[i]) == end:
            i += 1
        node.ends = i - lo  # sets that end here come first
        if node.ends:
            node.least = node.deepest = end
        below = []
        while i < hi:
            j, t = i + 1, sets[i][end]
            while j < hi and sets[j][end] == t:
                j += 1
            below.append((i, j, end, node))
            i = j
        stack += reversed(below)
    for node in reversed(made):  # kids come after their parents
        for kid in node.kids:
            node.least, node.deepest = min(node.least, kid.least), max(node.deepest, kid.deepest)
    return made[0]


def _settle(node: _Node, uf: UnionFind) -> bool:
    """Marks the subtrees whose sets are all in one component."""
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if not x.one:
            found.append(x)
            stack += x.kids
    for x in reversed(found):  # kids come after their parents
        x.one = all(c.one for c in x.kids) and len({uf.find(i) for i in (*range(x.lo, x.lo + x.ends), *(c.lo for c in x.kids))}) == 1
    return node.one


def _rare_first(sets: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """The sets with their tokens numbered from the rarest among them up, ascending: what differs comes first, so bounds end most visits early."""
    sizes = [len(x) for x in sets]
    toks, at, c = np.unique(np.concatenate([np.asarray(x, np.int64) for x in sets]), return_inverse=True, return_counts=True)
    number = np.empty(len(toks), np.int64)
    number[np.argsort(c, kind="stable")] = np.arange(len(toks))
    return [tuple(np.sort(x).tolist()) for x in np.split(number[at], np.cumsum(sizes)[:-1])]


def trie_links(sets: Sequence[Sequence[int]], side: list[int], num: int, den: int, token: int | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that, with the groups ``known`` (one number per set), span the graph that links sets with Jaccard >= num/den.

    ``side`` marks the block of a set; where both blocks occur, only pairs across them are tried, as pairs
    within a block meet elsewhere. Sets hold distinct tokens in one common order. Pairs that are
    connected already, one by one or as a whole subtree, are not tried again. With ``token``, only pairs whose first shared
    token it is are tried: the others meet in another bucket. Without it, the order may be any, and is that of the counts in ``sets``.
    """
    if not sets:
        return []
    sets = _rare_first(sets) if token is None else [tuple(x.tolist() if isinstance(x, np.ndarray) else x) for x in sets]
    n = len(sets)
    place = sorted(range(n), key=sets.__getitem__)
    sets, side = [sets[i] for i in place], [side[i] for i in place]
    both = len(set(side)) > 1
    uf, out = UnionFind(n), []
    if known:
        first: dict[int, int] = {}
        for i, p in enumerate(place):
            uf.join(first.setdefault(known[p], i), i)
    top = _Node((), 0, n)
    i = 0
    while i < n:  # the root's children, by first token
        j = i + 1
        while j < n and sets[j][0] == sets[i][0]:
            j += 1
        top.kids.append(_trie(sets, i, j, 0))
        i = j
    for c in top.kids if known else ():
        _settle(c, uf)
    settled = 0
    for x in range(n):
        xs, nx = None, len(sets[x])
        stack = [(c, 0, 0) for c in top.kids]
        while stack:
            node, depth, shared = stack.pop()
            # linked sets have |y| >= t|x| and |x| >= t|y|, and share at least t/(1+t) * (|x| + |y|) tokens
            if node.hi <= x + 1 or node.deepest * den < nx * num or node.least * num > nx * den or (node.one and uf.find(node.lo) == uf.find(x)):
                continue
            xs = xs or set(sets[x])
            if node.seg:
                both_have = xs.intersection(node.seg)
                if token is not None and not shared and both_have and next(t for t in node.seg if t in both_have) != token:
                    continue
                shared += len(both_have)
                depth += len(node.seg)
            need = -(-(nx + max(node.least, -(-nx * num // den))) * num // (num + den))
            left = node.deepest - depth
            if token is None and node.seg:  # x is ascending too: what it has up to here is shared or lost
                left = min(left, nx - bisect_right(sets[x], node.seg[-1]))
            if min(nx, shared + left) < need:
                continue
            for y in range(max(node.lo, x + 1), node.lo + node.ends):
                if (not both or side[x] != side[y]) and shared * den >= num * (nx + depth - shared) and uf.join(x, y):
                    out.append((place[x], place[y]))
            stack += [(c, depth, shared) for c in node.kids]
        if len(out) > settled + n // 16:
            settled = len(out)
            for c in top.kids:
                _settle(c, uf)
    return out


def class_links(docs: DataFrame, k: int, num: int, den: int, ranked: int = RANKED, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): rows has rid, id, key, n per row of ``docs`` (id, text, and rid if rows are numbered already); edges a, b between keys."""
    spark = docs.sparkSession
    numbered = docs if "rid" in docs.columns else docs.withColumn("rid", F.monotonically_increasing_id())
    order = spark.sparkContext.broadcast(ranks(materialise(token_counts(docs, k, num, den), "counts"), ranked))
    pools = materialise(set_table(numbered, k, num, den, order), "pools")
    one = pools.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"))
    heads = pools.where("n > 0").join(one.select("rid"), "rid", "left_semi")
    posts = heads.select("rid", F.col("n").cast("long").alias("n"), F.posexplode("toks").alias("at", "tok")).select("tok", "rid", "n", F.col("at").cast("long").alias("at"))
    posts = posts.repartition("tok").sortWithinPartitions("tok", "n").mapInArrow(_partnered(num, den), "tok bigint, rid bigint, n bigint, at bigint")
    posts = materialise(posts, "posts")
    # buckets with the same members do the same work: one token stands for all of them
    mark = [F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    buckets = posts.groupBy("tok").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at")).alias("one"), *mark)
    # the earliest in the global order, as the same member sees it
    chosen = buckets.groupBy("c", "x1", "x2").agg(F.min(F.struct("one.at", "tok")).getField("tok").alias("tok")).select("tok", "c")
    members = materialise(posts.join(chosen, "tok").join(pools.select("rid", "id", "key"), "rid"), "members")
    # the texts of all members, which other rows may have too: one row is taken of each set
    texts = materialise(text_table(docs, members.select("id"), k), "texts")
    sources = materialise(texts.groupBy("key").agg(F.min("no").alias("no")).join(members.select("key").distinct(), "key", "left_semi"), "sources")
    shape = (texts, sources, order, k, num, den, cap)
    # first the largest bucket of each class; a bucket whose members all have the same largest one lies within it
    best = members.groupBy("rid").agg(F.max(F.struct("c", "tok")).getField("tok").alias("best"))
    held = members.join(best, "rid")
    tops = best.select(F.col("best").alias("tok")).distinct()
    within = held.groupBy("tok").agg(F.min("best").alias("lo"), F.max("best").alias("hi")).where("lo = hi").select("tok")
    tried = members.join(tops, "tok", "left_semi").select(F.lit(True).alias("whole"), "tok", "c", "rid", "key", F.col("rid").alias("grp"))
    first = _links(tried, *shape)
    # then what holds members of several components; most buckets are done by now
    found = components(first).withColumnRenamed("node", "key")
    named = members.join(tops.unionByName(within), "tok", "left_anti").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = named.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    named = named.join(mixed, "tok", "left_semi").withColumn("grp", F.xxhash64("root")).select("tok", "rid", "n", "at", "grp", "c")
    apart = named.repartition("tok").sortWithinPartitions("tok", "n").mapInArrow(_partnered(num, den, ("grp", "c")), "tok bigint, rid bigint, n bigint, at bigint, grp bigint, c bigint")
    rest = _links(_together(materialise(apart.select("tok", "rid", "grp"), "apart"), cap).join(pools.select("rid", "key"), "rid"), *shape)
    return pools.select("rid", "id", "key", "n"), first.unionByName(rest)


def _partnered(num: int, den: int, more: tuple[str, ...] = (), reach: int = 64):
    """Keeps the rows (tok, rid, n, at and ``more``) that may link, across groups if there is a grp, within their bucket by this token, if it is the first one shared.

    Input is sorted by token and size. With x and y sharing no token before places i and j, the overlap is at most
    min(|x| - i, |y| - j). Buckets of more than ``reach`` rows of similar size are kept whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        names = ["tok", "rid", "n", "at", *more]

        def keep(t: pa.Table) -> pa.Table:
            tok, n, at = (t.column(c).to_numpy() for c in ("tok", "n", "at"))
            grp = t.column("grp").to_numpy() if more else None
            ok = np.zeros(len(tok), bool)
            x = np.arange(len(tok))
            for d in range(1, reach + 1):
                x = x[x < len(tok) - d]
                y = x + d
                x = x[(tok[x] == tok[y]) & (n[x] * den >= n[y] * num)]
                if not len(x):
                    break
                y = x + d
                hit = np.minimum(n[x] - at[x], n[y] - at[y]) * (num + den) >= num * (n[x] + n[y])
                if grp is not None:
                    hit &= grp[x] != grp[y]
                ok[x[hit]] = ok[y[hit]] = True
            if len(x):
                ok |= np.isin(tok, tok[x])
            return t.select(names).filter(pa.array(ok)).combine_chunks()

        hot = None  # a token too frequent to hold: its rows are let through as they come
        for b in batches:
            t = pa.Table.from_batches([b])
            if hot is not None:
                same = int(np.searchsorted(t.column("tok").to_numpy(), hot, side="right"))
                if same:
                    yield from t.slice(0, same).select(names).to_batches()
                t = t.slice(same)
                if not t.num_rows:
                    continue
                hot = None
            t = t if carry is None else pa.concat_tables([carry, t])
            tok = t.column("tok").to_numpy()
            if not len(tok):
                continue
            cut = int(np.searchsorted(tok, tok[-1]))
            if cut:
                yield from keep(t.slice(0, cut)).to_batches()
            carry = t.slice(cut)  # the last token may go on in the next batch
            if carry.num_rows > 100_000:
                hot = int(tok[-1])
                yield from carry.select(names).to_batches()
                carry = None
        if carry is not None and carry.num_rows:
            yield from keep(carry).to_batches()

    return run


def _together(apart: DataFrame, cap: int) -> DataFrame:
    """(whole, tok, c, rid, grp): the buckets of ``apart`` (tok, rid, grp), or in their place whole chains of overlapping buckets (``whole``).

    Chains are the components of the classes that share buckets, so all that a bucket tries meets in its chain too. A chain replaces its
    buckets where that sends fewer sets, with the blocks that each is split into counted.
    """
    sized = materialise(attach(apart, ["tok"], [("c", F.count("*")), ("least", F.min("rid"))], [F.sum("c"), F.min("least")], F.hash("rid")), "sized")
    chains = components(sized.select(F.col("rid").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("rid"), "root")
    sent = lambda c: F.ceil(c / F.lit(cap))
    per_class = sized.groupBy("rid").agg(F.sum(sent(F.col("c"))).alias("apart"), F.first("grp").alias("grp")).join(chains, "rid")
    per_class = attach(per_class, ["root"], [("n", F.count("*")), ("all", F.sum("apart"))], [F.sum("n"), F.sum("all")], F.hash("rid"))
    per_class = materialise(per_class.withColumn("whole", F.col("n") * sent(F.col("n")) <= F.col("all")), "chains")
    chained = per_class.where("whole").select("whole", F.col("root").alias("tok"), F.col("n").alias("c"), "rid", "grp")
    return chained.unionByName(sized.join(per_class.where("not whole").select("rid", "whole"), "rid").select("whole", "tok", "c", "rid", "grp"))


def _links(members: DataFrame, texts: DataFrame, sources: DataFrame, order, k: int, num: int, den: int, cap: int) -> DataFrame:
    """Edges within the buckets ``tok`` of ``members`` (whole, tok, c, rid, key, grp), between groups. ``sources`` names the row of ``texts`` of each set.

    Not ``whole``: only between sets whose first shared token is the bucket's.
    """
    by = ["whole", "tok", "blk_a", "blk_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for t in groups(batches, by):
            keys, token = t.column("key").to_pylist(), None if t.column("whole")[0].as_py() else t.column("tok")[0].as_py()
            sets = shingler.sets(t.column("text").cast(pa.large_string()).combine_chunks())
            sets = [x.view(np.int64) for x in sets] if token is None else in_order(sets, *order.value)
            found = trie_links(sets, t.column("blk").to_pylist(), num, den, token, t.column("grp").to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.binary()), pa.array([keys[j] for _, j in found], pa.binary())], ["a", "b"])

    named = materialise(members.join(sources, "key"), "named")
    tasks = block_pairs(named, "tok", "c", F.xxhash64("rid"), cap).join(sifted(texts.select("no", "text"), "no", named), "no").select(*by, "blk", "grp", "key", "text")
    return materialise(tasks.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary"), "links")


def jaccard_groups(docs: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 8, den: int = 10, ranked: int = RANKED, cap: int = CAP, rid_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` as (rid, id, n_shingles, component_id, kept): groups of texts linked by shingle-set Jaccard >= num/den.

    component_id is the smallest id reachable by links, the row's own included; exactly one row of each group is
    ``kept``. A null or wordless text has n_shingles 0, links with nothing and is kept. Rows with equal texts
    are in one group even where ids repeat; null ids count as larger than others. Other columns are not read.
    ``rid`` numbers the rows in a table that is written once, so all steps agree on it; with ``rid_col`` it is that column,
    whose values must be distinct and the same in each pass.
    """
    number = [F.col(rid_col).alias("rid")] if rid_col else []
    # workers get the texts in small batches; all that runs in Python is written within this block
    with session_conf(docs.sparkSession, execution_arrow_maxBytesPerBatch="4m"):
        rows, edges = class_links(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *number), k, num, den, ranked, cap)
    comp = components(edges)
    named = rows.join(comp.withColumnRenamed("node", "key"), "key", "left").select("rid", "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("grp"))
    least = named.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid")).alias("m"))
    return named.join(least, "grp", "left").select(
        "rid", "id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("id")).otherwise(F.col("m.id")).alias("component_id"), (F.col("grp").isNull() | (F.col("rid") == F.col("m.rid"))).alias("kept")
    )
