"""Retrieval: four ranked routes, fused by reciprocal ranks, then filtered, de-duplicated and paged.

A chunk table has vault, source, chunk_index, chunk_id, content, content_hash. Route functions return (chunk_id, rank): ranks are
given by ``row_number`` over a top-N, so only N rows ever meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.text import haystack, occurrences, overlapping, phrase_groups, split_acronyms
from foliary.sources.tables import stored

RRF_K = 60
PER_ROUTE = 40
K1, B = 1.2, 0.75
#: What names a chunk without hashing its content.
PLACE = ("source", "chunk_index")


def once(rows: DataFrame, name: str, over: Column, value: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``value(over)``, where both are worked out once for each row.

    A filter on a plain column would work it out again, below the projection that has it, and each of its terms would work out ``over`` again.
    """
    return rows.select("*", F.explode(F.transform(F.array(over), value)).alias(name))


def lexical_score(query: str, content: str = "content", aliases: Column | None = None, low: Column | None = None) -> Column:
    """Occurrences of the terms, five for each acronym as a word, ten where the whole query occurs. ``low``: the haystack, where it is known."""
    h = haystack(content, aliases) if low is None else low
    regular, acronyms = split_acronyms(query)
    score = reduce(lambda a, t: a + occurrences(h, t), regular, F.lit(0).cast("long")).cast("double")
    if acronyms:
        score = score + acronym_hits(acronyms, content)
    return score + F.when(F.contains(h, F.lit(query.strip().lower())), 10.0).otherwise(0.0)


def acronym_hits(acronyms: Sequence[str], content: str = "content") -> Column:
    """Five for each acronym that is a word of the text."""
    words = r"(?iU)\b(?:" + "|".join(sorted(set(acronyms))) + r")\b"
    return F.regexp_count(F.col(content), F.lit(words)) * 5.0


def _overlaps_itself(phrase: str) -> bool:
    return any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))


def _scored(chunks: DataFrame, query: str) -> DataFrame:
    return once(chunks, "lexical", haystack("content"), lambda h: lexical_score(query, low=h))


def _phrases(groups: Sequence[Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(p for g in groups for p in g))


def _frequencies(groups: Sequence[Sequence[str]], low: Column) -> Column:
    """How often each phrase occurs in a lower-case text, as an array."""
    return F.array(*[overlapping(low, p) for p in _phrases(groups)])


def _matches(groups: Sequence[Sequence[str]], tf: str) -> Column:
    """Any phrase of each group occurs."""
    flat = _phrases(groups)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(tf)[flat.index(p)] > 0 for p in g]) for g in groups])


def bm25_score(uses: Sequence[tuple[Column, Column]], size: Column) -> Column:
    """Sum over (frequency, number of chunks that have it) of phrases, given the columns __n and __avg: chunks, and their mean size."""
    score = F.lit(0.0)
    for tf, df in uses:
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("__avg")))
    return score


def bm25(chunks: DataFrame, query: str, content: str = "content") -> DataFrame:
    """chunks that match, with ``bm25`` (larger is better). A phrase's frequency counts overlaps in the lower-case text; a text's length is its
    number of trigrams; statistics are over all chunks, in one pass of partial aggregates whose single row is then joined.
    """
    groups = phrase_groups(query)
    if not groups:
        return chunks.limit(0).withColumn("bm25", F.lit(0.0))
    flat = _phrases(groups)
    rows = once(chunks.withColumn("__len", F.greatest(F.length(content) - 2, F.lit(0))), "__tf", F.lower(F.col(content)), lambda h: _frequencies(groups, h))
    stats = rows.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col("__tf")[i] > 0).cast("long")).alias(f"__df{i}") for i in range(len(flat))])
    score = bm25_score([(F.col("__tf")[flat.index(p)], F.col(f"__df{flat.index(p)}")) for g in groups for p in g], F.col("__len"))
    met = rows.where(_matches(groups, "__tf")).crossJoin(F.broadcast(stats))  # one row of statistics
    return met.withColumn("bm25", score).select(*chunks.columns, "bm25")


def top(rows: DataFrame, order: Sequence[Column], n: int, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """(key, rank) of the first ``n`` rows in this order."""
    first = rows.orderBy(*order).limit(n)
    return first.select(*key, F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def place(score: Column) -> list[Column]:
    """Descending score, then source, then position: the order of every result."""
    return [score.desc(), F.col("source"), F.col("chunk_index")]


def bm25_route(chunks: DataFrame, query: str, n: int = PER_ROUTE, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    return top(bm25(chunks, query), place(F.round("bm25", 9)), n, key)


def lexical_route(chunks: DataFrame, query: str, n: int = PER_ROUTE, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    return top(_scored(chunks, query).where("lexical > 0"), place(F.col("lexical")), n, key)


def exact_route(chunks: DataFrame, terms: Sequence[str], n: int = PER_ROUTE, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Chunks that hold every term, by occurrences."""
    return top(exact_matches(chunks, terms), place(F.col("hits")), n, key)


def clean_terms(terms: Sequence[str], most: int = 8, width: int = 100) -> list[str]:
    """Exact terms as they are looked for: trimmed, cut to ``width`` characters, in lower case, each once, blank ones left out; the first ``most`` of them.

    The limits bound the expression, and are the reference rule; a caller with longer lists raises them.
    """
    return list(dict.fromkeys(t for t in (str(x).strip()[:width].lower() for x in terms) if t))[:most]


def _held_terms(wanted: Sequence[str], h: Column) -> tuple[Column, Column]:
    """Whether every term is held, and how often they occur in all."""
    hits = reduce(lambda a, t: a + occurrences(h, t), wanted, F.lit(0).cast("long"))
    return reduce(lambda a, t: a & F.contains(h, F.lit(t)), wanted, F.lit(True)), hits


def exact_matches(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Chunks that hold every term, with ``hits``."""
    held, hits = _held_terms(clean_terms(terms), haystack("content"))
    return chunks.where(held).withColumn("hits", hits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a literal vector; 0 for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(vector, vector)) * F.lit(math.sqrt(sum(float(x) ** 2 for x in query)))
    return F.when(norm > 0, dot(vector, q) / norm).otherwise(0.0)


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, similarity (12 digits) of the k nearest; ties by key. A full scan with a top-k on each task."""
    return vectors.select(key, F.round(cosine(F.col(vector), query), 12).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def vector_route(chunks: DataFrame, vectors: DataFrame, query: Sequence[float], n: int = PER_ROUTE, key: str = "doc_id", name: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """(name, rank) of chunks by cosine of their vector (``vectors``: ``key``, embedding) with a literal one; those without a vector are left out.

    Similarities join chunk places only, not contents.
    """
    near = vectors.select(key, F.round(cosine(F.col("embedding"), query), 12).alias("similarity"))
    return top(chunks.select(key, *dict.fromkeys([*name, *PLACE])).join(near, key), place(F.col("similarity")), n, name)


def fuse(routes: Sequence[DataFrame], key: Sequence[str] = ("chunk_id",), k: int = RRF_K) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over the routes, added in route order so that doubles agree between runs."""
    tagged = reduce(DataFrame.unionByName, [r.select(*key, F.lit(i).alias("route"), "rank") for i, r in enumerate(routes)])
    ranks = [F.max(F.when(F.col("route") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(routes))]
    parts = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(routes))]
    return tagged.groupBy(*key).agg(*ranks).select(*key, reduce(lambda a, b: a + b, parts).alias("score"))


def text_routes(chunks: DataFrame, query: str, exact_terms: Sequence[str] = (), n: int = PER_ROUTE, with_bm25: bool = True) -> list[DataFrame]:
    """The BM25, lexical and exact routes of a query, by place, from one reading of the contents.

    That reading leaves a sheet of one narrow row for each chunk, without content, from which statistics and ranks are taken.
    """
    groups = phrase_groups(query) if with_bm25 else []
    terms = clean_terms(exact_terms)

    regular, acronyms = split_acronyms(query)
    # every term is counted once, whichever routes want it; phrases that overlap themselves are counted in another way
    flat = _phrases(groups)
    counted = list(dict.fromkeys([*((t, False) for t in [*regular, *terms]), *((p, _overlaps_itself(p)) for p in flat)]))

    def told(h: Column) -> Column:
        n = F.array(*[overlapping(h, t) if o else occurrences(h, t) for t, o in counted]) if counted else F.array().cast("array<bigint>")
        return F.struct(n.alias("n"), F.contains(h, F.lit(query.strip().lower())).alias("whole"))

    def n_of(t: str, overlapped: bool = False) -> Column:
        return F.col("told.n")[counted.index((t, overlapped))]

    read = once(chunks.select(*PLACE, "content"), "told", haystack("content"), told)
    lexical = reduce(lambda a, t: a + n_of(t), regular, F.lit(0).cast("long")).cast("double") + (acronym_hits(acronyms) if acronyms else F.lit(0.0)) + F.when(F.col("told.whole"), 10.0).otherwise(0.0)
    held = reduce(lambda a, t: a & (n_of(t) > 0), terms, F.lit(bool(terms)))
    exact = F.when(held, reduce(lambda a, t: a + n_of(t), terms, F.lit(0).cast("long")))
    tf = F.array(*[n_of(p, _overlaps_itself(p)) for p in flat]).cast("array<bigint>")
    size = F.greatest(F.length("content") - 2, F.lit(0))
    sheet = stored(read.select(*PLACE, size.alias("size"), lexical.alias("lexical"), tf.alias("tf"), exact.alias("exact")), "sheet")
    routes = []
    if groups:
        stats = sheet.agg(F.count("*").alias("__n"), F.avg("size").alias("__avg"), *[F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(flat))])
        score = bm25_score([(F.col("tf")[flat.index(p)], F.col(f"df{flat.index(p)}")) for g in groups for p in g], F.col("size"))
        met = sheet.where(_matches(groups, "tf")).crossJoin(F.broadcast(stats))  # one row of statistics
        routes.append(top(met.withColumn("bm25", score), place(F.round("bm25", 9)), n, PLACE))
    routes.append(top(sheet.where("lexical > 0"), place(F.col("lexical")), n, PLACE))
    if terms:
        routes.append(top(sheet.where("exact is not null"), place(F.col("exact")), n, PLACE))
    return routes


def fused_places(chunks: DataFrame, query: str, exact_terms: Sequence[str] = (), vector_route: DataFrame | None = None, per_route: int = PER_ROUTE, bm25: DataFrame | None = None) -> DataFrame:
    """source, chunk_index, score of what the routes find together: at most four times ``per_route`` rows.

    ``vector_route`` and ``bm25`` are routes by place that come from elsewhere, such as stored vectors and postings.
    """
    routes = text_routes(chunks, query, exact_terms, per_route, bm25 is None)
    first = [bm25] if bm25 is not None else routes[:1] if phrase_groups(query) else []
    rest = routes[len(first) if bm25 is None else 0 :]
    return fuse([*first, *([vector_route] if vector_route is not None else []), *rest], PLACE)


def hybrid(chunks: DataFrame, query: str, exact_terms: Sequence[str] = (), vector_route: DataFrame | None = None, per_route: int = PER_ROUTE, bm25: DataFrame | None = None) -> DataFrame:
    """``chunks`` that the fused routes find, with ``score``: two readings of the contents, the second for a bounded number of places."""
    return chunks.join(F.broadcast(fused_places(chunks, query, exact_terms, vector_route, per_route, bm25)), list(PLACE))


def fallback(chunks: DataFrame, query: str, similarity: DataFrame | None = None) -> DataFrame:
    """Without fused routes: similarity plus a fifth of the relative lexical score, or the lexical score alone where above zero."""
    scored = _scored(chunks, query)
    if similarity is None:
        return scored.where("lexical > 0").withColumn("score", F.col("lexical")).drop("lexical")
    met = scored.join(similarity, "chunk_id")
    best = met.agg(F.max("lexical").alias("__best"))
    rel = F.col("lexical") / F.when(F.col("__best") > 0, F.col("__best")).otherwise(1.0)
    return met.crossJoin(F.broadcast(best)).withColumn("score", F.col("similarity") + rel * 0.2).drop("lexical", "__best", "similarity")


def admitted(prefix: str = "", tags: Sequence[str] = (), since: float | None = None, until: float | None = None, tag_col: str = "tags", mtime_col: str = "mtime") -> Column:
    """Sources that begin with ``prefix``, any of ``tags`` (without # and case), and an mtime in the range, ends included; an unknown mtime passes.

    What is not given admits all.
    """
    ok = F.lit(True)
    if prefix.strip():
        ok &= F.col("source").startswith(prefix.strip().replace("\\", "/").rstrip("/"))
    wanted = [t.strip().lstrip("#").lower() for t in tags]
    if wanted:
        ok &= F.coalesce(F.arrays_overlap(F.transform(tag_col, lambda t: F.ltrim(F.lower(t), F.lit("#"))), F.array(*[F.lit(t) for t in wanted])), F.lit(False))
    if since is not None:
        ok &= F.col(mtime_col).isNull() | (F.col(mtime_col) >= since)
    if until is not None:
        ok &= F.col(mtime_col).isNull() | (F.col(mtime_col) <= until)
    return ok


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Of each group the longest beginning in this order whose sizes add up to at most ``budget``, with ``used``. Groups are pages of hits."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(line)).where(F.col("used") <= budget)


def dedupe(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order; rows with a null in the key all stay, each in a group of its own. A window group limit keeps one row per task and key."""
    open_ = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    n = F.row_number().over(Window.partitionBy(*keys, "__own").orderBy(*order))
    return rows.withColumn("__own", F.when(open_, F.monotonically_increasing_id())).withColumn("__n", n).where("__n = 1").drop("__own", "__n")


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def rerank(ranked: DataFrame, scores: DataFrame, cap: int = 60) -> DataFrame:
    """``ranked`` (pos from 0) reordered by ``scores`` (pos, relevance): scored of the first ``cap`` by relevance, then the unscored, then the rest.

    Adds new_pos. The capped head is at most ``cap`` rows.
    """
    met = ranked.join(F.broadcast(scores.where(F.col("pos") < cap)), "pos", "left")
    tier = F.when(F.col("pos") >= cap, 2).when(F.col("relevance").isNull(), 1).otherwise(0)
    return met.withColumn("new_pos", F.row_number().over(Window.orderBy(tier, F.desc_nulls_last("relevance"), "pos")) - 1)


def merge_vaults(hits: DataFrame, vaults: DataFrame, k: int, include_solo: bool = False) -> DataFrame:
    """Hits of all vaults, weighted: per vault the first k, scores times weight, sorted by weighted score, source, position, vault order.

    ``hits`` has vault, source, chunk_index, score; ``vaults`` has vault, weight, solo, position and is a registry: a row per vault.
    """
    use = vaults if include_solo else vaults.where("not solo")
    per = Window.partitionBy("vault").orderBy(*place(F.col("score")))
    top_k = hits.withColumn("__n", F.row_number().over(per)).where(F.col("__n") <= k).drop("__n")
    met = top_k.join(use.select("vault", "weight", "position"), "vault")
    return met.withColumn("score", F.col("score") * F.col("weight"))


def group_vaults(merged: DataFrame, limit: int, offset: int = 0, offsets: dict[str, int] | None = None) -> DataFrame:
    """A page of each vault, with ``max_score`` to sort the groups by. ``offsets`` names vaults whose page begins elsewhere."""
    best = F.max("score").over(Window.partitionBy("vault"))
    n = F.row_number().over(Window.partitionBy("vault").orderBy(*place(F.col("score"))))
    start = F.lit(offset)
    for vault, at in (offsets or {}).items():
        start = F.when(F.col("vault") == vault, at).otherwise(start)
    return merged.withColumns({"max_score": best, "pos": n}).where((F.col("pos") > start) & (F.col("pos") <= start + limit))
