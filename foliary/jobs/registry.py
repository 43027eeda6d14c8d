"""Every registered retrieval query with its DuckDB SQL. Both read the whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.functions import ignore
from foliary.functions import text as tx
from foliary.operators import answers, chunking, evaluation, facts, postings, reading, revisions, search, vectors
from foliary.sources import snapshots
from foliary.sources.tables import document_chunks, identified, plain_chunks, shared_folder, stored, table
from foliary.streaming import events as ev
from foliary.streaming import sources

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

QUERY = "License and the Apache version"
TERMS = ("the", "and", "license")
CHUNKS = "(SELECT source AS vault, 'doc/' || doc_id AS source, 0 AS chunk_index, coalesce(text, '') AS content, doc_id, lang, sha1('doc/' || doc_id || chr(0) || '0' || chr(0) || coalesce(text, '')) AS chunk_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents)"


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(table(spark, sf_dir, "documents"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(table(spark, sf_dir, "documents"))


#: With these a route's few rows can be named afterwards.
_NAMED = (*search.PLACE, "content")


def _occ(h: str, t: str) -> str:
    return f"CAST((length({h}) - length(replace({h}, '{t}', ''))) / {len(t)} AS BIGINT)"


def _lexical_sql(q: str, h: str = "lower(content)") -> str:
    regular, acronyms = tx.split_acronyms(q)
    parts = [_occ(h, t) for t in regular]
    if acronyms:
        w = "\\p{L}\\p{N}_"  # DuckDB's \\b knows ASCII only: separators are doubled, so that words do not share one
        parts.append(f"5 * len(regexp_extract_all(regexp_replace(content, '([^{w}])', '\\1\\1', 'g'), '(?i)(?:^|[^{w}])(?:{'|'.join(sorted(set(acronyms)))})(?:$|[^{w}])'))")
    return f"(CAST({' + '.join(parts) or '0'} AS DOUBLE) + CASE WHEN contains({h}, '{q.lower()}') THEN 10.0 ELSE 0.0 END)"


def _bm25_sql(q: str, chunks: str = CHUNKS) -> str:
    """chunk columns and bm25 of matching chunks."""
    groups = tx.phrase_groups(q)
    flat = list(dict.fromkeys(p for g in groups for p in g))
    tf = ", ".join(f"{_occ('lower(content)', p)} AS tf{i}" for i, p in enumerate(flat))
    df = ", ".join(f"sum(CAST(tf{i} > 0 AS BIGINT)) AS df{i}" for i in range(len(flat)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in (flat.index(p) for g in groups for p in g))
    match = " AND ".join("(" + " OR ".join(f"tf{flat.index(p)} > 0" for p in g) + ")" for g in groups)
    return f"(WITH r AS (SELECT *, {tf}, greatest(length(content) - 2, 0) AS len FROM {chunks}), s AS (SELECT count(*) AS n, avg(len) AS avglen, {df} FROM r) SELECT r.*, CAST({score} AS DOUBLE) AS bm25 FROM r, s WHERE {match})"


def _route_sql(rows: str, score: str, n: int = search.PER_ROUTE) -> str:
    return f"(SELECT chunk_id, row_number() OVER (ORDER BY {score} DESC, source, chunk_index) AS rank FROM {rows} QUALIFY rank <= {n})"


def _exact_sql(terms: tuple[str, ...]) -> str:
    hits = " + ".join(_occ("lower(content)", t) for t in terms)
    held = " AND ".join(f"contains(lower(content), '{t}')" for t in terms)
    return f"(SELECT *, {hits} AS hits FROM {CHUNKS} WHERE {held})"


LEX = f"(SELECT *, {_lexical_sql(QUERY)} AS lexical FROM {CHUNKS})"
ROUTES = [_route_sql(_bm25_sql(QUERY), "round(bm25, 9)"), _route_sql(f"(SELECT * FROM {LEX} WHERE lexical > 0)", "lexical"), _route_sql(_exact_sql(TERMS), "hits")]
_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * [%s][i]))" % ", ".join(f"{v}::DOUBLE" for v in _VECTOR)
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"
_QNORM = sum(v * v for v in _VECTOR) ** 0.5
VECTOR_ROUTE = _route_sql(f"(SELECT c.*, round({_DOT} / ({_NORM} * {_QNORM}), 12) AS similarity FROM {CHUNKS} c JOIN embeddings ON vec_id = doc_id)", "similarity")


def _fused_sql(routes: list[str]) -> str:
    names = "abcd"[: len(routes)]
    keys = " UNION ".join(f"SELECT chunk_id FROM {n}" for n in names)
    score = " + ".join(f"coalesce(1.0::DOUBLE / (60 + {n}.rank), 0.0)" for n in names)
    return f"(WITH {', '.join(f'{n} AS {r}' for n, r in zip(names, routes, strict=True))}, k AS ({keys}) SELECT k.chunk_id, {score} AS score FROM k {' '.join(f'LEFT JOIN {n} USING (chunk_id)' for n in names)})"


FUSED = _fused_sql([ROUTES[0], VECTOR_ROUTE, *ROUTES[1:]])
HYBRID = f"(SELECT c.*, f.score FROM {CHUNKS} c JOIN {FUSED} f USING (chunk_id))"


@query(f"SELECT doc_id, chunk_id, content_hash FROM {CHUNKS}")
def chunk_ids_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "chunk_id", "content_hash")


@query("SELECT regexp_extract(lower(url), '\\.([a-z0-9]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1")
def ext_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.regexp_extract(F.lower("url"), r"\.([a-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS chunks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents WHERE starts_with(source, 'src1') GROUP BY 1 ORDER BY source LIMIT 5 OFFSET 2")
def list_files_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("source").startswith("src1"))
    got = docs.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return search.page(got, [F.col("source")], 2, 5)


_RULES = ((r"^src1", True), (r"/[0-9]*7\.md$", False), (r"/[0-9]*77\.md$", True))


@query("SELECT doc_id, CASE WHEN regexp_matches(path, '/[0-9]*77\\.md$') THEN true WHEN regexp_matches(path, '/[0-9]*7\\.md$') THEN false WHEN regexp_matches(path, '^src1') THEN true ELSE false END AS is_ignored FROM (SELECT doc_id, source || '/' || doc_id || '.md' AS path FROM documents)")
def ignore_last_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return facts.ignored(docs, _RULES).select("doc_id", "is_ignored")


_GLOBS = ("# rules", "*7.md", "!src1*/", "SRC[2-4]/", "/src5/1?.md", "!src5/11.md", "src6", "!*77.md", "src1*/*0.md", "archive/")


@query("SELECT doc_id, coalesce(CASE WHEN regexp_matches(path, '^src1.*/.*0\\.md$') THEN true WHEN regexp_matches(path, '77\\.md$') THEN false WHEN starts_with(path, 'src6/') THEN true WHEN path = 'src5/11.md' THEN false WHEN regexp_matches(path, '^src5/1.\\.md$') THEN true WHEN regexp_matches(path, '^src[2-4]/') THEN true WHEN regexp_matches(path, '^src1[^/]*/') THEN false WHEN regexp_matches(path, '7\\.md$') THEN true END, false) AS is_ignored FROM (SELECT doc_id, source || '/' || doc_id || '.md' AS path FROM documents)")
def ignore_globs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an ignore file over paths of documents."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", ignore.is_ignored(path, _GLOBS).alias("is_ignored"))


@query(f"SELECT doc_id FROM {CHUNKS} WHERE starts_with(source, 'doc/1') AND vault IN ('src1', 'src2') AND list_has_any([lang, vault], ['de', 'src2'])")
def filter_prefix_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.arrays_overlap(F.array("lang", "vault"), F.array(F.lit("de"), F.lit("src2")))
    return chunks(spark, d).where(F.col("source").startswith("doc/1") & F.col("vault").isin("src1", "src2") & tags).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS mtime FROM orders) WHERE mtime IS NULL OR mtime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def mtime_null_pass(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("mtime", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    near = F.col("mtime").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return o.where(F.col("mtime").isNull() | near).select("o_orderkey", "o_orderstatus")


@query(f"SELECT doc_id, hits FROM {_exact_sql(TERMS)}")
def exact_terms_and(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_matches(plain(spark, d), TERMS).select("doc_id", "hits")


_CLEAN = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


def _snippet_sql(terms: list[str], w: int = 150) -> str:
    at = "coalesce(" + ", ".join(f"nullif(instr(lower(x), '{t}'), 0)" for t in terms if len(t) >= 2) + ", 0) - 1"
    return f"CASE WHEN n <= {w} THEN x WHEN pos0 < 0 THEN rtrim(substr(x, 1, {w})) || '...' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(substr(x, s + 1, e - s)) || (CASE WHEN e < n THEN '...' ELSE '' END) END", f"(SELECT *, CASE WHEN e - s0 < {w} THEN greatest(0, e - {w}) ELSE s0 END AS s FROM (SELECT *, least(n, s0 + {w}) AS e FROM (SELECT *, greatest(0, pos0 - {w // 2}) AS s0 FROM (SELECT *, length(x) AS n, {at} AS pos0 FROM (SELECT *, {_CLEAN} AS x FROM {CHUNKS})))))"


_SN, _SN_FROM = _snippet_sql(["version", "license"])


@query(f"SELECT doc_id, {_SN} AS snippet, length(content) AS char_count FROM {_SN_FROM}")
def preview_projection(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", tx.snippet("content", ["version", "license"]).alias("snippet"), F.length("content").cast("long").alias("char_count"))


@query(f"SELECT doc_id, {_lexical_sql(QUERY)} AS lexical FROM {CHUNKS}")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", search.lexical_score(QUERY).alias("lexical"))


@query(f"SELECT doc_id, {_lexical_sql('AI in IT of a plan')} AS lexical FROM {CHUNKS}")
def acronym_score(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", search.lexical_score("AI in IT of a plan").alias("lexical"))


@query(f"SELECT doc_id, round(bm25, 6) AS bm25 FROM {_bm25_sql(QUERY)}")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(chunks(spark, d), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT chunk_id, rank FROM {ROUTES[0]}")
def bm25_route(spark: SparkSession, d: str) -> DataFrame:
    return identified(search.bm25_route(plain(spark, d), QUERY, key=_NAMED)).select("chunk_id", "rank")


_LIVE = f"(SELECT * FROM {CHUNKS} WHERE doc_id % 7 <> 0)"
_LIVE_BM25 = _route_sql(_bm25_sql(QUERY, _LIVE), "round(bm25, 9)")


def _index(spark: SparkSession, d: str) -> postings.TrigramIndex:
    """All documents, after old contents of some were replaced and others were removed."""
    every = chunks(spark, d)
    index = postings.new_index(spark, shards=8, slots=8)
    old = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an old license "), "content")).otherwise(F.col("content"))
    index.upsert(every.where("doc_id % 3 > 0").withColumn("content", old))
    index.upsert(every.where("doc_id % 5 = 0 or doc_id % 3 = 0"), every.where("doc_id % 7 = 0").select("source"))
    index.delete(every.where("doc_id % 7 = 0").select("source"))
    return index


@query(f"SELECT chunk_id, rank FROM {_LIVE_BM25}")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 route from stored postings, after upserts and a delete."""
    return _index(spark, d).bm25_route(QUERY)


@query(f"SELECT count(*) AS chunks, CAST(sum(greatest(length(content) - 2, 0)) AS BIGINT) AS trigrams FROM {_LIVE}")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).chunks().agg(F.count("*").alias("chunks"), F.sum("size").alias("trigrams"))


@query(f"SELECT chunk_id, rank FROM {ROUTES[2]}")
def exact_route(spark: SparkSession, d: str) -> DataFrame:
    return identified(search.exact_route(plain(spark, d), TERMS, key=_NAMED)).select("chunk_id", "rank")


@query(f"SELECT vec_id, round({_DOT} / ({_NORM} * {_QNORM}), 6) AS similarity FROM embeddings ORDER BY round({_DOT} / ({_NORM} * {_QNORM}), 12) DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_topk(table(spark, d, "embeddings"), _VECTOR, 20).withColumn("similarity", F.round("similarity", 6))


def _store(spark: SparkSession, d: str) -> vectors.VectorStore:
    """Three quarters of the vectors, some of them replaced by their opposites; those of label 4 removed. A vector's source is its label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("source"), "embedding")
    store = vectors.new_store(spark, "test/64")
    store.train(e, 8)
    store.upsert(e.where("key % 4 > 0"))
    turned = e.where("key % 20 = 2").withColumn("embedding", F.transform("embedding", lambda x: -x))
    store.upsert(turned, e.where("source = '4' and key % 20 <> 2").select("source").distinct())
    return store


_STORED = "(SELECT vec_id, CASE WHEN vec_id % 20 = 2 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 4 > 0 AND (label <> 4 OR vec_id % 20 = 2))"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS key, round({_DOT} / ({_NORM} * {_QNORM}), 6) AS similarity FROM {_STORED} ORDER BY round({_DOT} / ({_NORM} * {_QNORM}), 12) DESC, key LIMIT 20")
def cosine_stored(spark: SparkSession, d: str) -> DataFrame:
    """The nearest in a stored table of cells, after an upsert and a removal."""
    found = _store(spark, d).search(_VECTOR, 20)
    return found.rows.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round({_DOT}, 9) AS dot FROM {_STORED} WHERE vec_id % 3 = 0")
def attach_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors of given chunks."""
    wanted = table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("chunk_id"))
    return _store(spark, d).attach(wanted).select("chunk_id", F.round(search.dot(F.col("embedding"), F.array(*[F.lit(v) for v in _VECTOR])), 9).alias("dot"))


@query(f"SELECT label, count(*) AS n, CAST(sum(CAST({_DOT} > 0 AS BIGINT)) AS BIGINT) AS ahead FROM embeddings GROUP BY label")
def cosine_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("s", search.cosine(F.col("embedding"), _VECTOR))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("s") > 0).cast("long")).alias("ahead"))


def _near(spark: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    vecs = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.vector_route(chunks if chunks is not None else plain(spark, d), vecs, _VECTOR, name=search.PLACE)


@query(f"SELECT chunk_id, rank FROM {VECTOR_ROUTE}")
def vector_route(spark: SparkSession, d: str) -> DataFrame:
    """Places are ranked first; only those found are named by their contents."""
    return identified(plain(spark, d).join(F.broadcast(_near(spark, d)), list(search.PLACE))).select("chunk_id", "rank")


@query(f"SELECT chunk_id, round(score, 9) AS score FROM {FUSED}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return identified(search.hybrid(plain(spark, d), QUERY, TERMS, _near(spark, d))).select("chunk_id", F.round("score", 9).alias("score"))


@query(f"SELECT source, vault, round(score, 9) AS score FROM (SELECT * FROM {HYBRID} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY score DESC, source, chunk_index) = 1) ORDER BY score DESC, source, chunk_index LIMIT 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Four routes, fusion, de-duplication and the first page."""
    got = identified(search.hybrid(plain(spark, d), QUERY, TERMS, _near(spark, d)))
    order = search.place(F.col("score"))
    return search.page(search.dedupe(got, ["content_hash"], order), order, 0, 10).select("source", "vault", F.round("score", 9).alias("score"))


@query(f"SELECT source, vault, round(score, 9) AS score FROM {HYBRID} WHERE starts_with(source, 'doc/') AND list_has_any([lower(lang), lower(vault)], ['en', 'src0']) AND (doc_id % 3 = 0 OR doc_id >= 40)")
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """All fused hits that pass a prefix, tags, and a range of mtime, which one row in three does not know (its doc_id stands for it)."""
    got = search.hybrid(plain(spark, d), QUERY, TERMS, _near(spark, d))
    got = got.withColumn("tags", F.array("lang", "vault")).withColumn("mtime", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    return got.where(search.admitted("doc/", ["#EN", "src0"], since=40)).select("source", "vault", F.round("score", 9).alias("score"))


@query(f"SELECT doc_id, lexical AS score FROM {LEX} WHERE lexical > 0 ORDER BY lexical DESC, source, chunk_index LIMIT 25")
def fallback_rank(spark: SparkSession, d: str) -> DataFrame:
    got = search.fallback(plain(spark, d), QUERY)
    return search.page(got, search.place(F.col("score")), 0, 25).select("doc_id", "score")


@query(f"SELECT doc_id FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY source, chunk_index) = 1")
def dedupe_hash(spark: SparkSession, d: str) -> DataFrame:
    return search.dedupe(chunks(spark, d), ["content_hash"], [F.col("source"), F.col("chunk_index")]).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'system' UNION ALL (SELECT conv_id, turn FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1)")
def dedupe_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("kind", F.when(F.col("role") != "system", F.col("role")))
    return search.dedupe(rows, ["conv_id", "kind"], [F.col("turn")]).select("conv_id", "turn")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR (l.toxic = 0 AND d.doc_id % 3 = l.quality)")
def visibility_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("source"), (F.col("doc_id") % 3).alias("revision"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("source"), F.when(F.col("toxic") == 0, "active").otherwise("deleted").alias("visibility"), F.col("quality").cast("long").alias("active_revision"))
    return facts.visible(rows, known).select("doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents QUALIFY pos < 100), s AS (SELECT r.*, CASE WHEN pos < 60 THEN CAST(l.quality AS DOUBLE) END AS relevance FROM r LEFT JOIN labels l USING (doc_id)) SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN pos >= 60 THEN 2 WHEN relevance IS NULL THEN 1 ELSE 0 END, relevance DESC NULLS LAST, pos) - 1 AS new_pos FROM s")
def rerank_reorder(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    ranked = first.select("doc_id", (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("pos"))
    scores = ranked.join(table(spark, d, "labels"), "doc_id").select("pos", F.col("quality").cast("double").alias("relevance"))
    return search.rerank(ranked, scores).select("doc_id", F.col("new_pos").cast("long").alias("new_pos"))


_VAULTS = "(SELECT 'src' || i AS vault, 1.0::DOUBLE + i / 4 AS weight, i % 7 = 3 AS solo, i AS position FROM range(20) t(i))"
_MERGED = f"(SELECT h.* EXCLUDE (lexical), lexical * weight AS score, v.position FROM (SELECT * FROM {LEX} WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY vault ORDER BY lexical DESC, source, chunk_index) <= 20) h JOIN {_VAULTS} v USING (vault) WHERE NOT solo)"


def _vaults(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.col("source").alias("vault")).distinct()
    i = F.regexp_extract("vault", r"(\d+)", 1).cast("int")
    return names.select("vault", (1.0 + i / 4).alias("weight"), (i % 7 == 3).alias("solo"), i.alias("position"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return search.fallback(plain(spark, d), QUERY)


@query(f"SELECT vault, source, round(score, 6) AS score FROM {_MERGED} ORDER BY score DESC, source, chunk_index, position LIMIT 30")
def fanout_weighted(spark: SparkSession, d: str) -> DataFrame:
    got = search.merge_vaults(_hits(spark, d), _vaults(spark, d), 20)
    return search.page(got, [*search.place(F.col("score")), F.col("position")], 0, 30).select("vault", "source", F.round("score", 6).alias("score"))


@query(f"SELECT vault, source, pos, round(max_score, 6) AS max_score FROM (SELECT *, max(score) OVER (PARTITION BY vault) AS max_score, row_number() OVER (PARTITION BY vault ORDER BY score DESC, source, chunk_index) AS pos FROM {_MERGED}) WHERE pos > 1 AND pos <= 4")
def fanout_grouped(spark: SparkSession, d: str) -> DataFrame:
    got = search.group_vaults(search.merge_vaults(_hits(spark, d), _vaults(spark, d), 20), 3, 1)
    return got.select("vault", "source", F.col("pos").cast("long").alias("pos"), F.round("max_score", 6).alias("max_score"))


@query(f"SELECT vault, source, pos, round(max_score, 6) AS max_score FROM (SELECT *, max(score) OVER (PARTITION BY vault) AS max_score, row_number() OVER (PARTITION BY vault ORDER BY score DESC, source, chunk_index) AS pos, CASE vault WHEN 'src1' THEN 2 WHEN 'src4' THEN 0 ELSE 1 END AS o FROM {_MERGED}) WHERE pos > o AND pos <= o + 3")
def fanout_offsets(spark: SparkSession, d: str) -> DataFrame:
    got = search.group_vaults(search.merge_vaults(_hits(spark, d), _vaults(spark, d), 20), 3, 1, {"src1": 2, "src4": 0})
    return got.select("vault", "source", F.col("pos").cast("long").alias("pos"), F.round("max_score", 6).alias("max_score"))


@query(f"SELECT vault, source, used FROM (SELECT vault, source, CAST(sum(strlen(content) + 200) OVER (PARTITION BY vault ORDER BY score DESC, source, chunk_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM {_MERGED}) WHERE used <= 60000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of each vault's ranked hits as many as fit into 60000 bytes, each with 200 of its own."""
    hits = search.merge_vaults(_hits(spark, d), _vaults(spark, d), 20)
    got = search.within_budget(hits, ["vault"], search.place(F.col("score")), F.octet_length("content") + 200, 60000)
    return got.select("vault", "source", F.col("used").cast("long").alias("used"))


@query(f"WITH m AS (SELECT doc_id, content_hash FROM {CHUNKS} WHERE doc_id % 2 = 1), g AS (SELECT content_hash, min(doc_id) AS donor_id FROM {CHUNKS} WHERE doc_id % 2 = 0 GROUP BY 1) SELECT m.doc_id, g.donor_id FROM m LEFT JOIN g USING (content_hash)")
def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select(F.col("doc_id").alias("id"), "content_hash")
    return facts.reuse_vectors(c.where("id % 2 = 1"), c.where("id % 2 = 0"), "content_hash").select(F.col("id").alias("doc_id"), "donor_id")


@query(f"SELECT count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(ceil(count(*) / 32.0) AS BIGINT) AS batches FROM (SELECT content_hash, max(length(content)) AS chars FROM {CHUNKS} WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1)")
def reembed_cost(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    new = chunks(spark, d).join(have, "doc_id", "left_anti").groupBy("content_hash").agg(F.max(F.length("content")).alias("chars"))
    return new.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.ceil(F.count("*") / 32).alias("batches"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def removed_sources(spark: SparkSession, d: str) -> DataFrame:
    return facts.unreferenced(table(spark, d, "customer"), "c_custkey", (table(spark, d, "orders"), "o_custkey")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def gc_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = li.where("l_quantity > 45"), li.where("l_returnflag = 'R' and l_quantity > 40")
    return facts.unreferenced(table(spark, d, "part"), "p_partkey", (a, "l_partkey"), (b, "l_partkey")).select("p_partkey")


_SPANS = "(SELECT event_id AS id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 1 + CAST(floor(abs(value)) AS BIGINT) % 900 AS \"end\" FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", start.alias("start"), (start + 1 + F.floor(F.abs("value")) % 900).alias("end"))


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM {_SPANS} a JOIN {_SPANS} b ON a.user_id = b.user_id AND a.start < b.\"end\" AND b.start < a.\"end\" WHERE a.event_type = 'click' AND b.event_type <> 'click'")
def overlap_links(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return facts.overlaps(s.where("event_type = 'click'"), s.where("event_type <> 'click'"), "user_id", 1800)


@query(f"WITH a AS (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_SPANS}), g AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS p FROM a) SELECT user_id, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM g GROUP BY user_id, p")
def merge_islands(spark: SparkSession, d: str) -> DataFrame:
    return facts.islands(_spans(spark, d), ["user_id"])


_LEVELS = "(SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)"


@query(f"SELECT a.conv_id, a.turn, min(b.turn) AS next_at FROM {_LEVELS} a LEFT JOIN {_LEVELS} b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY 1, 2")
def next_heading(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = table(spark, d, "conversations").select("conv_id", "turn", level.alias("level"))
    return facts.next_at_most(rows, "conv_id", "turn", "level").select("conv_id", "turn", "next_at")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def revision_latest(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders QUALIFY age > 2")
def prune_keep_two(spark: SparkSession, d: str) -> DataFrame:
    return facts.prune(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("age").cast("long").alias("age"))


@query("WITH RECURSIVE r AS (SELECT user_id, CAST(0 AS BIGINT) AS v, min(event_id) AS seen FROM events WHERE event_id % 5 = 0 GROUP BY 1 UNION ALL SELECT user_id, v + 1, (SELECT min(e.event_id) FROM events e WHERE e.user_id IS NOT DISTINCT FROM r.user_id AND e.event_id % 5 = r.v + 1 AND e.event_id > r.seen) FROM r WHERE v < 5 AND seen IS NOT NULL) SELECT user_id, v AS version, seen AS event_id FROM r WHERE seen IS NOT NULL")
def cas_fold(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").withColumn("expected", F.col("event_id") % 5)
    return facts.cas_fold(log, "user_id", "event_id", "expected")


@query("SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1")
def job_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT CAST((SELECT coalesce(sum(strlen(coalesce(text, ''))), 0) FROM documents) + (SELECT coalesce(sum(strlen(coalesce(html, ''))), 0) FROM pages) + (SELECT count(*) * 256 FROM pages) AS BIGINT) AS used")
def quota_sum(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("a"))
    pages = table(spark, d, "pages").agg((F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) + F.count("*") * 256).alias("b"))
    return docs.crossJoin(pages).select((F.col("a") + F.col("b")).alias("used"))  # a row each


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS slice, len(string_split(text, chr(10))) > 4 AS more FROM documents WHERE text IS NOT NULL")
def line_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").withColumn("l", F.split("text", "\n", -1))
    return rows.select("doc_id", F.array_join(F.slice("l", 2, 3), "\n").alias("slice"), (F.size("l") > 4).alias("more"))


@query("SELECT doc_id, substr(text, 101, 80) AS part, CASE WHEN length(text) > 180 THEN 180 END AS next_char FROM documents WHERE text IS NOT NULL")
def char_cursor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring("text", 101, 80).alias("part"), F.when(F.length("text") > 180, 180).alias("next_char"))


@query("SELECT doc_id, sha256(CASE WHEN length(t) = 0 OR t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END) AS sha FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents)")
def markdown_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.normalised_markdown(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query("SELECT gram, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY 1")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.trigrams("text"))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("docs"))


_TOKENS = "SELECT doc_id, (15 * len(regexp_extract_all(t, '\\s')) + 130 * len(regexp_extract_all(t, '[A-Za-z0-9_]+')) + 25 * (length(t) - len(regexp_extract_all(t, '[^A-Za-z0-9_]')) - len(regexp_extract_all(t, '[A-Za-z0-9_]+'))) + 115 * len(regexp_extract_all(t, '[^A-Za-z0-9_\\s]'))) / 100.0::DOUBLE AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(_TOKENS)
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"SELECT lang, count(*) AS n, round(CAST(sum(e) AS DOUBLE) / count(*), 6) AS mean_error, CAST(max(e) AS DOUBLE) AS max_error FROM (SELECT lang, CAST(round(abs(tokens - words) / greatest(words, 1), 9) AS DECIMAL(20, 9)) AS e FROM (SELECT lang, tokens, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM documents JOIN ({_TOKENS}) USING (doc_id))) GROUP BY 1")
def token_error(spark: SparkSession, d: str) -> DataFrame:
    """How far the estimate is from the number of words, by language."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("lang", chunking.estimated_tokens(t).alias("tokens"), F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words"))
    return facts.estimate_error(rows, "lang", "tokens", "words")


@query("SELECT item_id, round((('0x' || substr(sha256(text), 1, 2))::INT / 127.5 - 1.0) / (('0x' || substr(sha256(text), 3, 2))::INT / 127.5 - 1.0), 6) AS ratio FROM benchmark")
def static_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The ratio of the first two components does not depend on the norm."""
    e = table(spark, d, "benchmark").withColumn("e", chunking.hash_embedding("text"))
    return e.select("item_id", F.round(F.col("e")[0] / F.col("e")[1], 6).alias("ratio"))


@query()
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return chunking.chunk_documents(docs, "path", "text").select("source", "chunk_index", "chunk_id", "heading", "start_line", "end_line", "content_hash")


def _chunk_sql(cost: str, between: int, end: str, again: str, drop: str, content: str, columns: str) -> str:
    """Chunks of documents with a word on each line: ``u`` has the running sums of costs, of which each step finds the next end and what is repeated."""
    return f"""WITH RECURSIVE
w AS (SELECT doc_id, string_split(replace(coalesce(text, ''), ' ', chr(10)), chr(10)) AS a FROM documents),
t AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM w),
l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM t),
f AS (SELECT *, min(CASE WHEN trim(x, ' ' || chr(9)) <> '' THEN i END) OVER (PARTITION BY doc_id) AS lead FROM l),
s AS (SELECT doc_id, lead, x, i, sum(({cost}) + {between}) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM f WHERE i >= lead),
d AS (SELECT doc_id, any_value(lead) AS lead, list(x ORDER BY i) AS lines, list_prepend(0, list(u ORDER BY i)) AS u FROM s GROUP BY doc_id),
r AS (
  SELECT doc_id, 0 AS n, 0 AS a, least(len(lines), greatest(1, len(list_filter(u, lambda v: v <= {end.format(a='0')})) - 1)) AS z FROM d
  UNION ALL
  SELECT doc_id, n, a, least(len(lines), greatest(z0 + 1, len(list_filter(u, lambda v: v <= {end.format(a='u[a + 1]')})) - 1)) FROM (
    SELECT r.doc_id, r.n + 1 AS n, CASE WHEN {drop} THEN z ELSE least(z, greatest(a, {again})) END AS a, z AS z0, d.u, d.lines FROM r JOIN d USING (doc_id) WHERE z < len(d.lines)
  )
)
SELECT {columns} FROM (SELECT 'doc/' || doc_id || '.md' AS source, CAST(n AS INTEGER) AS chunk_index, CAST(lead + a AS INTEGER) AS start_line, CAST(lead + z - 1 AS INTEGER) AS end_line, {content} AS content FROM r JOIN d USING (doc_id))"""


_ID = "source, chunk_index, start_line, end_line, sha1(source || chr(0) || chunk_index || chr(0) || content) AS chunk_id, substr(sha256(content), 1, 16) AS content_hash"
_COST = "15 * len(regexp_extract_all(x, '\\s')) + 130 * len(regexp_extract_all(x, '[A-Za-z0-9_]+')) + 25 * (length(x) - len(regexp_extract_all(x, '[^A-Za-z0-9_]')) - len(regexp_extract_all(x, '[A-Za-z0-9_]+'))) + 115 * len(regexp_extract_all(x, '[^A-Za-z0-9_\\s]'))"
_TAIL = "len(list_filter(u, lambda v: v < u[z + 1] - 6415))"


def _worded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a word on each line."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    return table(spark, d, "documents").select(path, F.replace("text", F.lit(" "), F.lit("\n")).alias("text"), F.col("source").alias("vault"), "doc_id", "lang")


@query(_chunk_sql(_COST, 15, "{a} + 38415", _TAIL, f"u[z + 2] - u[greatest(a, {_TAIL}) + 1] > 76815", "array_to_string(lines[a + 1 : z], chr(10))", _ID))
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 384 estimated tokens, 64 of them repeated."""
    return chunking.chunk_documents_by_tokens(_worded(spark, d), "path", "text").select("source", "chunk_index", "start_line", "end_line", "chunk_id", "content_hash")


_CHAR_CONTENT = "regexp_replace(array_to_string(lines[a + 1 : z], chr(10)), '^\\s+|\\s+$', '', 'g')"


@query(_chunk_sql("length(x)", 1, "{a} + 800", "len(list_filter(u, lambda v: v <= u[z + 1] - 120)) - 1", "false", _CHAR_CONTENT, _ID))
def chunk_char_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 800 characters, 120 of them repeated."""
    return chunking.chunk_documents(_worded(spark, d), "path", "text").select("source", "chunk_index", "start_line", "end_line", "chunk_id", "content_hash")


_REAL = _chunk_sql("length(x)", 1, "{a} + 800", "len(list_filter(u, lambda v: v <= u[z + 1] - 120)) - 1", "false", _CHAR_CONTENT, f"{_ID}, content, doc_id").replace("AS content FROM r JOIN", "AS content, doc_id FROM r JOIN")
_REAL = f"SELECT r.*, o.source AS vault, o.lang FROM ({_REAL}) r JOIN documents o USING (doc_id)"


@query(f"WITH pieces AS MATERIALIZED ({_REAL}) SELECT source, chunk_index, vault, round(score, 9) AS score FROM (SELECT * FROM {HYBRID.replace(CHUNKS, 'pieces')} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY score DESC, source, chunk_index) = 1) ORDER BY score DESC, source, chunk_index LIMIT 25")
def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks of 800 characters, searched by four routes, without repeats. A chunk has its document's vector."""
    made = chunking.chunk_documents(_worded(spark, d), "path", "text", keep=("vault", "doc_id", "lang"))
    made = stored(made.select("vault", "source", "chunk_index", "content", "doc_id"), "chunks")  # cut once, searched twice
    got = identified(search.hybrid(made, QUERY, TERMS, _near(spark, d, made)))
    order = search.place(F.col("score"))
    return search.page(search.dedupe(got, ["content_hash"], order), order, 0, 25).select("source", "chunk_index", "vault", F.round("score", 9).alias("score"))


@query()
def chunk_tokens_whole(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by estimated tokens of the documents as they are, where long lines are cut."""
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return chunking.chunk_documents_by_tokens(docs, "path", "text").select("source", "chunk_index", "chunk_id", "heading", "start_line", "end_line", "start_char", "end_char", "content_hash", "tokens", "oversize")


_RANKED = "(SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank, CAST(coalesce(quality, 0) AS DOUBLE) AS relevance FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, rank) AS best FROM {_RANKED}), a AS (SELECT query, max(CAST(rank <= 10 AND relevance > 0 AS INT)) AS hit, min(CASE WHEN relevance > 0 THEN rank END) AS f, sum(CAST(rank <= 10 AND relevance > 0 AS INT)) AS g, sum(CAST(relevance > 0 AS INT)) AS n, sum(CASE WHEN rank <= 10 THEN round((pow(2, relevance) - 1) / log2(rank + 1.0), 12)::DECIMAL(30, 12) END) AS dcg, sum(CASE WHEN best <= 10 THEN round((pow(2, relevance) - 1) / log2(best + 1.0), 12)::DECIMAL(30, 12) END) AS idcg FROM r GROUP BY 1) SELECT query, hit, round(coalesce(1.0::DOUBLE / f, 0.0), 9) AS rr, CASE WHEN n > 0 THEN round(g::DOUBLE / n::DOUBLE, 9) ELSE 0.0 END AS recall, CASE WHEN idcg > 0 THEN round(dcg::DOUBLE / idcg::DOUBLE, 9) ELSE 0.0 END AS ndcg FROM a")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").withColumn("rank", rank).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return facts.ranking_metrics(rows.select(F.col("source").alias("query"), "rank", F.coalesce("quality", F.lit(0)).cast("double").alias("relevance")), 10)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(20, 2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events"))


@query("WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ev.first_of_each(table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


_KIND = "CASE WHEN event_type IN ('view', 'purchase') THEN 'stage' WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'invalidate' END WHEN event_type = 'click' AND event_id % 4 < 2 THEN CASE WHEN event_id % 4 = 0 THEN 'discard' ELSE 'visibility' END ELSE 'commit' END"
_STEPS = f"""WITH RECURSIVE k AS (SELECT user_id, event_id, {_KIND} AS kind FROM events WHERE user_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS rn, last_value(CASE WHEN kind = 'stage' THEN event_id END IGNORE NULLS) OVER w AS cand FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CASE WHEN kind NOT IN ('visibility', 'invalidate', 'delete') THEN 'r' || CASE WHEN event_id % 11 = 0 AND kind <> 'stage' THEN 0 ELSE cand END END AS rev, CASE WHEN kind = 'stage' THEN 'x' || event_id % 2 WHEN kind = 'commit' AND event_id % 5 = 0 THEN 'x0' END AS sha, CASE WHEN kind = 'commit' AND event_id % 4 = 0 THEN event_id % 3 END AS expected, CASE WHEN kind = 'visibility' THEN CASE event_id % 3 WHEN 0 THEN 'exempt' WHEN 1 THEN 'active' ELSE 'bad' END END AS val FROM p),
r AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS vis, CAST(NULL AS VARCHAR) AS act, CAST(0 AS BIGINT) AS num, CAST(NULL AS VARCHAR) AS staged, CAST(NULL AS VARCHAR) AS ssha, false AS ok FROM l
  UNION ALL
  SELECT user_id, rn,
    CASE WHEN NOT ok THEN vis WHEN kind = 'stage' THEN coalesce(vis, 'unverified') WHEN kind = 'commit' AND vis <> 'exempt' THEN 'active' WHEN kind = 'visibility' THEN val WHEN kind = 'invalidate' THEN 'unverified' WHEN kind = 'delete' THEN 'deleted' ELSE vis END,
    CASE WHEN ok AND kind = 'commit' AND vis <> 'exempt' THEN rev WHEN ok AND kind = 'delete' THEN NULL ELSE act END,
    num + CASE WHEN ok AND kind IN ('commit', 'delete') THEN 1 ELSE 0 END,
    CASE WHEN NOT ok THEN staged WHEN kind = 'stage' THEN rev WHEN kind IN ('commit', 'discard') THEN NULL ELSE staged END,
    CASE WHEN ok AND kind = 'stage' THEN sha ELSE ssha END, ok
  FROM (SELECT r.user_id, l.rn, r.vis, r.act, r.num, r.staged, r.ssha, l.kind, l.rev, l.sha, l.val, CASE l.kind WHEN 'stage' THEN true WHEN 'commit' THEN coalesce(l.rev = r.staged, false) AND coalesce(l.expected = r.num, true) AND coalesce(l.sha = r.ssha, true) AND NOT (r.vis = 'deleted' AND l.expected IS NULL) WHEN 'discard' THEN coalesce(l.rev = r.staged, false) WHEN 'visibility' THEN r.vis IS NOT NULL AND l.val <> 'bad' WHEN 'invalidate' THEN r.vis IS NOT NULL ELSE coalesce(r.vis <> 'deleted', false) END AS ok FROM r JOIN l ON r.user_id = l.user_id AND l.rn = r.rn + 1)
)
SELECT CAST(user_id AS VARCHAR) AS source, max_by(vis, rn) AS visibility, max_by(CASE WHEN act IS NULL THEN '' ELSE act END, rn) AS active, max(num) AS number, sum(CAST(ok AS INT)) AS accepted FROM r GROUP BY 1 HAVING max_by(vis, rn) IS NOT NULL"""


@query(_STEPS.replace("sum(CAST(ok AS INT))", "CAST(sum(CAST(ok AS INT)) AS BIGINT)"))
def revision_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of revisions: what each source ends with, and how many events were accepted."""
    kind = F.when(F.col("event_type").isin("view", "purchase"), "stage").when(F.col("event_type") == "error", F.when(F.expr("event_id % 3 = 0"), "delete").otherwise("invalidate"))
    kind = kind.when(F.expr("event_type = 'click' and event_id % 4 < 2"), F.when(F.expr("event_id % 4 = 0"), "discard").otherwise("visibility")).otherwise("commit")
    line = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").where("user_id is not null").select("user_id", "event_id", kind.alias("kind"))
    e = e.withColumn("cand", F.last(F.when(F.col("kind") == "stage", F.col("event_id")), ignorenulls=True).over(line))
    log = e.selectExpr(
        "event_id as seq", "cast(user_id as string) as source", "kind",
        "case when kind not in ('visibility', 'invalidate', 'delete') then concat('r', case when event_id % 11 = 0 and kind <> 'stage' then 0 else cand end) end as revision",
        "case when kind = 'stage' then concat('x', event_id % 2) when kind = 'commit' and event_id % 5 = 0 then 'x0' end as sha",
        "case when kind = 'commit' and event_id % 4 = 0 then event_id % 3 end as expected",
        "case when kind = 'visibility' then case event_id % 3 when 0 then 'exempt' when 1 then 'active' else 'bad' end end as value",
        "cast(null as string) as blob",
    )
    told = stored(revisions.verdicts(log), "verdicts")
    accepted = told.groupBy("source").agg(F.sum((F.col("verdict") == "accepted").cast("long")).alias("accepted"))
    return revisions.documents(told).join(accepted, "source").select("source", "visibility", F.coalesce("active", F.lit("")).alias("active"), "number", "accepted")


_LOG = "(SELECT CAST(user_id AS VARCHAR) AS source, ts AS tm, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'sample' END AS kind, CASE WHEN event_type NOT IN ('error', 'purchase') THEN CAST(floor(value / 100) AS BIGINT) END AS size, event_type AS sha FROM events)"
_PLACE = "PARTITION BY source ORDER BY tm, kind, size NULLS FIRST, sha"
_SETTLED = f"""WITH l AS (SELECT *, last_value(CASE WHEN kind = 'sample' THEN size END IGNORE NULLS) OVER ({_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(CAST(kind = 'done' AS INT)) OVER ({_PLACE} ROWS UNBOUNDED PRECEDING) AS run FROM {_LOG}),
s AS (SELECT *, kind = 'sample' AND size <> 0 AND coalesce(size = before, false) AS settled FROM l),
t AS (SELECT *, last_value(CASE WHEN settled THEN sha END IGNORE NULLS) OVER ({_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ledger, min(CASE WHEN kind <> 'sample' THEN tm END) OVER ({_PLACE} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, CASE WHEN kind = 'failed' THEN sum(CAST(kind = 'failed' AS INT)) OVER (PARTITION BY source, run ORDER BY tm, kind, size NULLS FIRST, sha ROWS UNBOUNDED PRECEDING) ELSE 0 END AS failures FROM s),
u AS (SELECT *, tm + to_seconds(CAST(60 * pow(2, failures - 1) AS BIGINT)) AS due FROM t WHERE kind = 'failed'),
o AS (SELECT source, CASE WHEN kind <> 'sample' THEN kind WHEN size = 0 THEN 'empty' WHEN NOT settled THEN 'settling' WHEN ledger IS NULL THEN 'new' WHEN ledger = sha THEN 'seen' ELSE 'changed' END AS status, failures FROM t
UNION ALL SELECT source, CASE WHEN failures >= 5 THEN 'gave_up' ELSE 'retry' END, failures FROM u WHERE due < (SELECT max(ts) FROM events) AND (nxt IS NULL OR nxt > due))
SELECT source, status, count(*) AS n, CAST(max(failures) AS BIGINT) AS most_failures FROM o GROUP BY 1, 2"""


@query(_SETTLED)
def source_status(spark: SparkSession, d: str) -> DataFrame:
    """How often a source was in each state: errors are failures, purchases ends of work, and all other events samples of a file."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("sample")
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.lit(0.0).alias("mtime"), F.when(kind == "sample", F.floor(F.col("value") / 100)).alias("size"), F.col("event_type").alias("sha"))
    return sources.statuses(log).groupBy("source", "status").agg(F.count("*").alias("n"), F.max("failures").alias("most_failures"))


_TREE = "(SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn % 3 AS name, '> ' || replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations)"
_HEADED = f"""WITH t AS {_TREE}, h AS (SELECT *, repeat('#', level) || ' ' || name || chr(10) || body AS part, 2 * pos - 1 AS line FROM t),
e AS (SELECT a.conv_id, a.pos, a.name, a.line, coalesce(min(b.pos), max(a.last) + 1) AS stop FROM (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM h) a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.pos > a.pos AND b.level <= a.level GROUP BY 1, 2, 3, 4),
q AS (SELECT conv_id, count(*) FILTER (name = 'user 1') AS n, min(pos) FILTER (name = 'user 1') AS pos FROM h GROUP BY 1),
f AS (SELECT q.conv_id, q.n, e.line, e.pos, e.stop FROM q LEFT JOIN e ON q.n = 1 AND e.conv_id = q.conv_id AND e.pos = q.pos)
SELECT CAST(conv_id AS VARCHAR) AS source, CASE n WHEN 0 THEN 'no heading' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS state, CAST(line AS INTEGER) AS start_line, CAST(2 * stop - 2 AS INTEGER) AS end_line, CASE WHEN n = 1 THEN sha256((SELECT string_agg(part, chr(10) ORDER BY pos) FROM h WHERE h.conv_id = f.conv_id AND h.pos >= f.pos AND h.pos < f.stop)) END AS sha FROM f"""


@query(_HEADED)
def heading_slice(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents with a heading for each turn: the section "user 1" of each."""
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    body = F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ")
    part = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "role", F.lit(" "), (F.col("turn") % 3).cast("string"), F.lit("\n> "), body)
    turns = table(spark, d, "conversations").select("conv_id", F.row_number().over(line).alias("pos"), part.alias("part"))
    docs = turns.groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("text"))
    docs = stored(docs, "documents")
    got = reading.read_heading(docs, "source", "text", docs.select("source", F.lit(" user 1 ").alias("heading")))
    return got.select("source", "state", "start_line", "end_line", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id, content, len(string_split(content, chr(10))) - 1 + 2 - CASE WHEN cut AND ends_with(content, chr(10)) THEN 1 ELSE 0 END AS end_line, cut AS truncated FROM (SELECT doc_id, substr(whole, 1, 120) AS content, length(whole) > 120 AS cut FROM (SELECT doc_id, substr(array_to_string(a[2:5], chr(10)), 4) AS whole, a FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM documents WHERE text IS NOT NULL) WHERE len(a) >= 2 AND length(a[2]) >= 3))")
def line_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 5 of each document from their fourth character, 120 characters at most."""
    got = table(spark, d, "documents").select("doc_id", reading.read_lines(F.col("text"), 2, 5, 3, 120).alias("r")).where("r is not null")
    return got.select("doc_id", "r.content", F.col("r.end_line").cast("long").alias("end_line"), "r.truncated")


@query("WITH n AS (SELECT 'src' || (doc_id % 40) AS stem, doc_id FROM documents) SELECT link, CASE WHEN c IS NULL THEN 'unknown' WHEN c > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN c = 1 THEN target END AS target, coalesce(c, 0) AS n FROM (SELECT '[[Notes/' || upper('src' || p_partkey) || '|see]]' AS link, 'src' || p_partkey AS stem FROM part) LEFT JOIN (SELECT stem, count(*) AS c, min(stem || '/' || stem || '.md') AS target FROM (SELECT DISTINCT stem, doc_id % 80 AS k FROM n WHERE doc_id % 80 < 60) GROUP BY 1) USING (stem)")
def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    """Links by name to files, of which some have the same name in two folders."""
    name = F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string"))
    files = table(spark, d, "documents").where("doc_id % 80 < 60").select(F.concat(F.when(F.expr("doc_id % 80 < 40"), F.lit("")).otherwise("z/"), name, F.lit("/"), name, F.lit(".md")).alias("source")).distinct()
    links = table(spark, d, "part").select(F.concat(F.lit("[[Notes/"), F.upper(F.concat(F.lit("src"), F.col("p_partkey").cast("string"))), F.lit("|see]]")).alias("link"))
    return reading.resolve_links(links, files)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def snapshot_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents and vectors exported, checked and taken over."""
    made = {"space": "test/64"}
    path, target = shared_folder(spark, "snapshot"), shared_folder(spark, "taken")
    snapshots.export(spark, path, {"documents": table(spark, d, "documents"), "vectors": table(spark, d, "embeddings")}, made)
    snapshots.take_over(spark, path, target, made, {"vectors": ["space"]})
    return spark.read.parquet(f"{target}/documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


_BASE, _BUDGET, _OFFSET = {"query": QUERY, "count": "many"}, 1500, 8
_BARE = json.dumps({"content": [{"type": "text", "text": json.dumps(_BASE | {"chunks": [], "truncated": None, "returned": 0, "next_offset": 0})}]})
_FIXED = len(_BARE) - len("null") - 2


@query(f"""WITH i AS (SELECT source, doc_id, strlen('{{"id": ' || doc_id || ', "chars": ' || coalesce(n_chars, 0) || '}}') + 4 AS cost FROM documents),
s AS (SELECT source, row_number() OVER w AS k, count(*) OVER (PARTITION BY source) AS n, {_FIXED} + sum(cost) OVER w + 2 * (row_number() OVER w - 1) AS size FROM i WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, size + length(CAST(k AS VARCHAR)) + length(CAST(k + {_OFFSET} AS VARCHAR)) AS bytes FROM s),
g AS (SELECT source, any_value(n) AS n, max(CASE WHEN k = n THEN bytes END) + 5 AS whole, max(CASE WHEN k < n AND bytes + 4 <= {_BUDGET} THEN k END) AS k, max(CASE WHEN k < n AND bytes + 4 <= {_BUDGET} THEN bytes END) + 4 AS part FROM t GROUP BY 1)
SELECT source, CASE WHEN whole <= {_BUDGET} THEN n ELSE k END AS returned, CAST(CASE WHEN whole <= {_BUDGET} THEN n ELSE k END + {_OFFSET} AS BIGINT) AS next_offset, CAST(CASE WHEN whole <= {_BUDGET} THEN whole ELSE part END AS BIGINT) AS bytes, whole > {_BUDGET} AS truncated FROM g""")
def answer_budget(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source fit into an answer of 1500 bytes."""
    item = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "chars": '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("}"))
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    got = answers.within_answer(rows, ["source"], [F.col("doc_id")], item, _BASE, _BUDGET, _OFFSET)
    return got.select("source", "returned", "next_offset", "bytes", "truncated")


@query("WITH q AS (SELECT row_number() OVER (ORDER BY o_custkey, delta) - 1 AS i, delta FROM (SELECT o_custkey, CAST(round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) / count(*), 12) AS DECIMAL(30, 12)) AS delta FROM orders GROUP BY 1)), n AS (SELECT count(*) AS n FROM q), r AS (SELECT id // n AS b, ('0x' || substr(md5('17:' || id), 1, 8))::BIGINT % n AS i FROM n, range(500 * (SELECT n FROM n)) t(id)), m AS (SELECT b, CAST(sum(delta) AS DOUBLE) / any_value(n) AS m FROM r JOIN q USING (i), n GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS at_ FROM m) SELECT n, round((SELECT CAST(sum(delta) AS DOUBLE) FROM q) / n, 9) AS mean, round((SELECT m FROM o WHERE at_ = 12), 9) AS low, round((SELECT m FROM o WHERE at_ = 487), 9) AS high FROM n")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean of a difference by customer, over 500 samples with replacement."""
    delta = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)) / F.count("*")
    got = evaluation.bootstrap_interval(table(spark, d, "orders").groupBy("o_custkey").agg(delta.alias("delta")), "o_custkey", "delta")
    return got.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS at_, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, f AS fraction, value FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(f) WHERE at_ = CAST(floor((n - 1) * f) AS BIGINT)")
def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.percentiles(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


@query("SELECT count(*) AS total, CASE WHEN count(*) > 12 THEN 12 END::BIGINT AS next_offset, count(*) > 12 AS page_truncated FROM (SELECT DISTINCT source FROM documents WHERE starts_with(source, 'src1'))")
def listing_info(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").where(F.col("source").startswith("src1")).select("source").distinct()
    return answers.listing(sources, [F.col("source")], 5, 7)[1]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
