"""The training-data operators against brute force, exact round trips and hand-made cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import chat, edit_fingerprint, embedding_dedup, line_dedup, mixing, ngram_join, packing, token_files, tokens, toxicity, warc_writer
from foliary.llm.common import Shingler, attach, shared_dir
from foliary.llm.graph import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): prose, near copies, equal texts, null, empty, blank, short and long ones."""
    r = random.Random(seed)
    texts = [prose(r, r.randrange(20, 120)) for _ in range(n)]
    for i in range(n // 2):
        w = texts[i % 5].split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "One two", "ONE TWO", texts[0], texts[0].upper(), prose(r, 4000)]
    return list(enumerate(texts))


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"rid": F.lit("x"), "KEY": F.lit(1), "n": F.lit(None).cast("int"), "shard": F.lit("s")})  # clashing names


def written(spark, df, name):
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def union(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "num", "den", "cap"), [(3, 90, 100, 400), (5, 8, 10, 7)])
def test_ngram_groups_are_exact(spark, k, num, den, cap):
    rows = corpus()
    sets = {i: shingle_set(t, k) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])]
    want = union(sets, pairs)
    got = ngram_join.jaccard_groups(docs_of(spark, rows), "doc_id", "text", k, num, den, ranked=50, cap=cap).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_ngram_groups_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.jaccard_groups(docs_of(spark, []), "doc_id", "text").count() == 0
    got = ngram_join.jaccard_groups(docs_of(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, None)]), "doc_id", "text").collect()
    assert sorted((r.component_id or -1, r.kept) for r in got) == [(-1, True), (3, False), (3, False), (3, True)]


def test_shingler_agrees_with_sets():
    import pyarrow as pa

    texts = [t for _, t in corpus(5)]
    got = Shingler(3, chunk=500).sets(pa.array(texts)[2:])
    for t, s in zip(texts[2:], got, strict=True):
        assert len(s) == len(shingle_set(t, 3))


def test_components_agree_with_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(70)] + [(600, 600 + i) for i in range(90)]
    want = union({x for e in edges for x in e}, edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_attach_meets_nulls_and_hot_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)] + [("b", i) for i in range(50)], "k string, v int")
    got = attach(df, ["k"], [("top", F.max("v"))], [F.max("top")], F.hash("v")).collect()
    assert len(got) == 53 and {(r.k, r.top) for r in got} == {(None, 2), ("a", 5), ("b", 49)}


def test_mix_reaches_targets(spark):
    r = random.Random(4)
    rows = [(i, prose(r, r.randrange(1, 60)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(1000, None, "a"), (1001, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size_", F.lit(1))
    took = mixing.allocate(df, "source", ["doc_id"], mixing.words("text"), shards=5, block=500).collect()
    again = mixing.allocate(df.repartition(7), "source", ["doc_id"], mixing.words("text"), shards=5, block=500).collect()
    assert {(x.doc_id, x.taken, tuple(x.shard_copies)) for x in took} == {(x.doc_id, x.taken, tuple(x.shard_copies)) for x in again}
    sizes = collections.Counter()
    for x in took:
        assert x.size == len((x.text or "").split()) and x.taken <= 3 * x.size
        sizes[x.source] += x.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.water_fill(np.array([sizes[s] for s in names], float), np.array([5, 2, 1, 5, 2][: len(names)], float), sum(sizes.values()), 3)
    for s, g in zip(names, goal, strict=True):
        mine = [x for x in took if x.source == s]
        assert {round(x.target, 6) for x in mine} == {round(g, 6)} and abs(sum(x.taken for x in mine) - g) <= 60
    copies = mixing.mix(df, key_cols=("doc_id",), shards=5, block=500)
    assert copies.count() == sum(len(x.shard_copies) for x in took) and "shard" in copies.columns


def test_mix_takes_only_what_the_tree_deals(spark, monkeypatch):
    rows = [(i, "word " * 20, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("own") for c in ("s", "b", "c0", "target", "size", "shards", "place", "doc", "w", "quota", "src")})
    took = mixing.allocate(df, "source", ["doc_id"], mixing.words("text"), shards=4, block=100)
    assert {(x.s, x.shards, x.doc) for x in took.collect()} == {("own", "own", "own")}
    assert took.agg(F.sum("taken")).first()[0] > 3000
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, rng: np.zeros((shards, len(quotas)), np.int64))
    none = mixing.allocate(df, "source", ["doc_id"], mixing.words("text"), shards=4, block=100)
    assert none.agg(F.sum("taken")).first()[0] == 0
    assert mixing.allocate(df.limit(0), "source", ["doc_id"], mixing.words("text")).count() == 0


def test_split_tree_exhausts_quotas():
    q = np.array([100, 7, 0, 53])
    out = mixing.split_tree(q, 9, np.random.default_rng(0))
    assert (out.sum(axis=0) == q).all() and np.ptp(out.sum(axis=1)) <= 1
    assert sorted(mixing.permute(np.arange(1000), np.full(1000, 1000), 3).tolist()) == list(range(1000))
    assert mixing.water_fill(np.array([10.0, 100.0]), np.array([5.0, 1.0]), 110.0, 3).tolist() == [30.0, 80.0]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_agrees_with_whole_texts(model):
    r = random.Random(6)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", " don't", "é", "12", " ", "　", ".", "!!", "\r\n", "x y", "日本", "\x1c", "<|endoftext|>", "́"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(3000)]
    want = [e.ids + [2] for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(tokens.default_path()).encode(texts, 2)] == want


def test_token_files_round_trip(spark, model):
    rows = corpus(7) + [(3, "twice"), (None, "no id")]
    r = token_files.token_digests(docs_of(spark, rows), "doc_id", "text", 2).collect()
    assert len(r) == len(rows)
    start = 0
    for x in sorted(r, key=lambda x: x.start):
        assert x.start == start
        start += x.n_tokens
    assert [x.doc_id for x in sorted(r, key=lambda x: x.start)] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in corpus(7)}
    for x in r:
        if x.doc_id not in (3, None):
            assert (x.n_tokens, x.ids_crc32) == (len(ids[x.doc_id]), zlib.crc32(np.array(ids[x.doc_id], "<u4").tobytes()))
    assert token_files.token_digests(docs_of(spark, []), "doc_id", "text", 2).count() == 0


def test_packing_is_whole_and_tight(spark, model):
    rows = corpus(8, 200)
    r = packing.pack_documents(docs_of(spark, rows), "doc_id", "text", capacity=128).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for x in r:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append(x)
    for i, t in rows:
        ids, at = model.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, x in enumerate(sorted(by_doc[i], key=lambda x: x.piece)):
            assert (x.piece, x.start) == (k, at) and (k == 0 or x.length == 128)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 128
    assert len(by_seq) <= 1.05 * sum(x.length for x in r) / 128 + 3
    assert packing.pack_documents(docs_of(spark, []), "doc_id", "text").count() == 0


def test_plan_holds_every_piece():
    r = random.Random(9)
    for _ in range(4):
        h = {n: r.randrange(1, 400) for n in r.sample(range(1, 257), 90)}
        runs = packing.plan(h, 256)
        have = collections.Counter()
        for times, lengths in runs:
            assert sum(lengths) <= 256
            for n in lengths:
                have[n] += times
        assert have == h
        used = sum(t for t, _ in runs)
        assert used <= sum(t for t, _ in packing._best_fit([], dict(h), 256))
        # no plan can beat the words in all, nor pair two lengths above half
        assert used <= 1.06 * max(sum(n * c for n, c in h.items()) / 256, sum(c for n, c in h.items() if n > 128))


def test_plan_of_rounded_lengths_needs_hardly_more_than_the_bound():
    r = random.Random(31)
    h = collections.Counter(min(1024, 1 + int(r.paretovariate(0.8) * 90)) for _ in range(6000))
    large = {n: c for n, c in h.items() if n > 1024 * packing.SMALL and n != 1024}
    assert len(large) > packing.GROUPS and len(packing._rounded(large, packing.GROUPS)) <= packing.GROUPS
    runs = packing._configured(dict(large), 1024, packing.GROUPS)
    # most large pieces are placed by configurations, not by the best fit that follows
    assert sum(t * len(lengths) for t, lengths in runs) >= 0.9 * sum(large.values())
    used, words = sum(t for t, _ in packing.plan(h, 1024)), sum(n * c for n, c in h.items())
    assert used <= 1.01 * max(words / 1024, sum(c for n, c in h.items() if n > 512)) + 1
    assert packing.plan({}, 1024) == [] and packing.plan({1024: 3}, 1024) == [(3, [1024])]


def test_pack_replaces_places_and_refuses_lengths_out_of_range(spark):
    rows = [(1, 0, 5, "a", 7), (1, 0, 5, "a", 7), (2, 0, 3, "b", 8), (None, 0, 8, None, 9)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, Offset string, sequence_id long")
    got = packing.pack(parts, 8)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert sorted(collections.Counter(x.sequence_id for x in got.collect()).values()) == [1, 1, 2]
    assert packing.pack(parts.limit(0), 8).count() == 0
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, bad)], "doc_id long, piece int, length long"), 8)


def test_toxicity_learns_from_its_own_rows_only(spark):
    r = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = prose(r, 60).split()
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grobble!", "Snark,", "blatz"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "x " * 20000)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = dict(labels)
    labels = [(i, 1 - y if i in held else y) for i, y in labels]  # wrong labels on held-out rows must not matter
    got = toxicity.label_toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(x.held_out == (x.doc_id in held) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    test = [x for x in got if x.doc_id in held and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in test) >= 0.97 * len(test)
    assert toxicity.label_toxicity(docs_of(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).where("predicted = 1").count() == 0


def test_edit_fingerprints(spark):
    rows = corpus(11) + [(None, "no id")]
    got = edit_fingerprint.fingerprint_with_edits(docs_of(spark, rows), "doc_id", "text").collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for (i, t), (j, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one = edit_fingerprint.digest_pairs([(0, edited, "")])[0][3]
        assert by[i].edited_fingerprint == one
        assert by[i].near_next == edit_fingerprint.likeness(by[i].fingerprint, by[j].fingerprint)
        if len(t) > 100:
            assert by[i].near_edited > 0.6
    assert by[0].fingerprint == by[96 if rows[96][1] == rows[0][1] else 0].fingerprint


def test_edit_distance_and_groups(spark):
    r = random.Random(12)
    for _ in range(60):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert edit_fingerprint.edit_distance(a, b) == d[-1][-1]
    base = prose(r, 80)
    near = base[:200] + "X" + base[203:]
    rows = [(5, base), (2, near), (9, base), (7, prose(r, 80)), (8, None), (4, "")]
    got = {x.id: x.component_id for x in edit_fingerprint.edit_groups(docs_of(spark, rows), "doc_id", "text").collect()}
    assert got == {5: 2, 2: 2, 9: 2, 7: 7, 8: 4, 4: 4}


def test_chat_escapes_round_trip():
    for t in ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[\\INST", "a\\", "[TURN =x\\ ] ", "", "[/ANS <s></s>\\\\["]:
        assert chat.unescape(chat.escape(t)) == t
        for role in ("user", "assistant", "system", "tool", "a\\ ] b", None, ""):
            s, lo, hi = chat.render(role, t, True)
            assert chat.read(s) == (role, t)
            assert not chat._CONTROL.search(chat.escape(t))
            assert chat.unescape(s[lo:hi]) == (t if role == "assistant" else "")


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "He"),
        (1, 1, 2, "delta", "assistant", "llo"),
        (1, 1, 3, "regenerate", "assistant", None),
        (1, 1, 5, "delta", "assistant", "ye!"),
        (1, 1, 4, "delta", "assistant", "B"),
        (1, 0, 6, "edit", None, "hi there"),
        (2, 0, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, msg long, seq long, op string, role string, text string")
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "Bye!"), (2, 0): (None, "")}
    d = {r.conv_id: r for r in chat.digest_chats(chat.reconstruct(events)).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"Bye!").hexdigest() and d[1].loss_chars == 4 and d[1].n_turns == 2
    assert d[1].turns_sha256 == hashlib.sha256(b"user\nhi there\nassistant\nBye!\n").hexdigest()
    assert chat.digest_chats(chat.reconstruct(events.limit(0))).count() == 0


def test_line_dedup(spark):
    r = random.Random(13)
    lines = [prose(r, 40) for _ in range(6)]
    near = lines[0].replace("alpha", "alphb", 1) if "alpha" in lines[0] else lines[0][:-1] + "#"
    rows = [
        (2, "\n".join([lines[0], "short line", lines[1]])),
        (1, "\n".join([lines[2], "", lines[1].upper() + " !!"])),
        (3, "\n".join([near, "short line", lines[3], lines[3]])),
        (4, None),
        (5, ""),
        (6, prose(r, 40000)),
        (2, lines[4] + "\n"),
    ]
    out = line_dedup.dedup_lines(written(spark, docs_of(spark, rows), "lines")).collect()
    got = {(x.doc_id, x.n_lines): x for x in out}
    assert len(out) == 7
    assert got[1, 3].n_dropped == 0 and got[2, 3].text == "\n".join([lines[0], "short line"])
    assert got[3, 4].text.split("\n")[-1] == lines[3] and got[3, 4].n_dropped >= 1
    assert got[4, 0].text is None and got[5, 1].text == "" and got[6, 1].n_dropped == 0 and got[2, 2].text == lines[4] + "\n"


def test_simhash_blocks_are_those_of_the_heaviest_features(spark):
    import bisect

    import xxhash

    r = random.Random(14)
    texts = [prose(r, n) for n in (1, 5, 100, 1000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)))
    for t, got in df.select("t", line_dedup.simhash(*line_dedup.with_points(F.col("h")))).collect():
        h = sorted((x - (1 << 64) if x >> 63 else x) for x in (xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split()))
        assert got == [h[bisect.bisect_left(h, p) % len(h)] & ((1 << 31) - 1) for p in line_dedup.POINTS]


def test_warc_round_trip(spark):
    r = random.Random(15)
    body = "<html>" + prose(r, 300) + "é</html>"
    rows = [(i, f"http://x/{i}", body if i % 3 else f"<p>{prose(r, 50)}") for i in range(40)] + [(50, "http://y\r\nz", None), (51, None, ""), (None, "u", body), (20, "again", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(0))
    got = warc_writer.archive(df).collect()
    assert len(got) == len(rows) and all(x.checked for x in got)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for x in got:
        h = next((h or "") for i, u, h in rows if i == x.page_id and (i is not None or u == "u"))
        assert x.payload_bytes == len(h.encode()) and x.payload_digest == warc_writer.digest(h.encode())
        assert (x.record_type, x.refers_to) == (("response", None) if last[h] == x.page_id else ("revisit", last[h]))
    assert warc_writer.archive(df.limit(0)).count() == 0


def test_embedding_groups(spark):
    g = np.random.default_rng(16)
    base = g.standard_normal((12, 16))
    vecs = [(base[i % 12] + g.standard_normal(16) * s).tolist() for i in range(120) for s in (0.08,)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(200, vecs[0], 0), (201, vecs[0], 0), (202, vecs[0], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [1.0, None], 0), (207, [1.0, 2.0], 0), (208, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k"))
    got = {r.id: r for r in embedding_dedup.embedding_groups(df, "vec_id", "embedding", "label", cap=9).collect()}
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, y in rows if i < 202}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    want = union(got, links)
    n = collections.Counter(x for e in links for x in e)
    found = sum(r.n_links for r in got.values()) / 2
    assert found <= len(links) and found >= 0.97 * len(links)
    assert all(got[i].n_links <= n[i] for i in got) and all(got[i].n_links == 0 for i in range(202, 209))
    assert sum(got[i].component_id == want[i] for i in got) >= 0.97 * len(got)
    assert all(r.kept == (r.id == r.component_id) for r in got.values())
    assert embedding_dedup.embedding_groups(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_pipeline_on_a_small_folder(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(17)
    rows = [(i, prose(r, 80) + "\n" + prose(r, 30), "en", f"s{i % 4}", 0) for i in range(80)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, None, "en", None, 0), (102, "", None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
