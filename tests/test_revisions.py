"""The revision log on random events, against a store that is updated in place."""

import random

import pytest

from foliary.operators import revisions as rv

LOG = "seq bigint, source string, kind string, revision string, sha string, expected bigint, value string, blob string"


def random_log(seed, n):
    r = random.Random(seed)
    rows, staged, count = [], {}, {}
    for i in range(n):
        s = f"s{r.randrange(8)}"
        kind = r.choice(["stage", "stage", "attach", "commit", "commit", "commit", "discard", "visibility", "invalidate", "delete"])
        rev, sha, expected, value, blob = None, None, None, None, None
        if kind == "stage":
            rev, sha = f"r{i}", r.choice(["x", "y", None] if r.random() < 0.1 else ["x", "y"])
            staged[s] = rev
        elif kind in ("attach", "commit", "discard"):
            rev = staged.get(s) if r.random() < 0.9 else f"r{r.randrange(n)}"
            sha = r.choice(["x", None, None]) if kind == "commit" else None
            expected = r.choice([None, None, count.get(s, 0), r.randrange(4)]) if kind == "commit" else None
            value, blob = (r.choice("abc"), r.choice(["b1", "b2", "b9"])) if kind == "attach" else (None, None)
        elif kind == "visibility":
            value = r.choice(["active", "exempt", "exempt", "bad"])
        if kind in ("commit", "delete"):
            count[s] = count.get(s, 0) + r.randrange(2)
        rows.append((i, s, kind, rev, sha, expected, value, blob))
    return rows


def store(rows, blobs):
    """Tables that every event changes at once."""
    docs, revs, occ, out = {}, {}, {}, {}
    for seq, s, kind, rev, sha, expected, value, blob in rows:
        d = docs.get(s)
        mine = [x for x in revs if revs[x]["source"] == s]
        cand = next((x for x in mine if revs[x]["state"] == "staged"), None)
        ok = True
        if kind == "stage":
            ok = bool(rev and sha) and rev not in revs
            if ok:
                d = docs.setdefault(s, {"active": None, "visibility": "unverified", "number": 0})
                if cand:
                    del revs[cand]
                revs[rev] = {"source": s, "state": "staged", "sha": sha, "seq": seq}
        elif kind == "attach":
            ok = rev is not None and rev == cand and blobs.get(blob, 10**9) < seq and (rev, value) not in occ
            if ok:
                occ[rev, value] = blob
        elif kind == "commit":
            ok = rev is not None and rev == cand and expected in (None, d["number"]) and sha in (None, revs[rev]["sha"]) and not (d["visibility"] == "deleted" and expected is None)
            if ok:
                keep = {rev, d["active"]}
                revs[rev] |= {"state": "committed", "seq": seq}
                d["number"] += 1
                if d["visibility"] != "exempt":
                    d |= {"active": rev, "visibility": "active"}
                for x in mine:
                    if x not in keep:
                        del revs[x]
        elif kind == "discard":
            ok = rev is not None and rev == cand
            if ok:
                del revs[rev]
        elif kind == "visibility":
            ok = d is not None and value in rv.VISIBILITIES
            if ok:
                d["visibility"] = value
        elif kind == "invalidate":
            ok = d is not None
            if ok:
                d["visibility"] = "unverified"
        else:
            ok = d is not None and d["visibility"] != "deleted"
            if ok:
                d |= {"visibility": "deleted", "active": None}
                d["number"] += 1
        out[seq] = ok
    return docs, revs, occ, out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_log_gives_what_a_store_holds(spark, seed):
    rows, blobs = random_log(seed, 600), {"b1": 0, "b2": 200}
    docs, revs, occ, ok = store(rows, blobs)
    blob_df = spark.createDataFrame([(b, s, f"type/{b}") for b, s in blobs.items()], "blob string, seq bigint, mime string")
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    log = spark.createDataFrame([*shuffled, (None, "s1", "delete", *[None] * 5), (5, None, "delete", *[None] * 5)], LOG).repartition(5)
    told = rv.verdicts(log, blob_df).cache()
    assert {r.seq: r.verdict == "accepted" for r in told.collect()} == ok
    assert {r.source: (r.active, r.visibility, r.number) for r in rv.documents(told).collect()} == {s: (d["active"], d["visibility"], d["number"]) for s, d in docs.items()}
    assert {(r.revision, r.source, r.state, r.seq) for r in rv.kept_revisions(told).collect()} == {(x, v["source"], v["state"], v["seq"]) for x, v in revs.items()}
    assert {(r.source, r.revision) for r in rv.active_revisions(told).collect()} == {(s, d["active"]) for s, d in docs.items() if d["visibility"] == "active" and d["active"]}
    want = {(rev, o, b, f"type/{b}") for (rev, o), b in occ.items() if rev in revs}
    assert {(r.revision, r.occurrence, r.blob, r.mime) for r in rv.occurrences(told, blob_df).collect()} == want and want
    last = max(s for s, good in ok.items() if good and rows[s][2] in ("commit", "delete"))
    marks = spark.createDataFrame([("a", 1, 0, "ready"), ("a", 9, last, "ready"), ("b", 1, last - 1, "ready"), ("c", 1, 0, "failed")], "profile string, seq bigint, captured bigint, status string")
    assert {r.profile: r.status for r in rv.derived_status(marks, told).collect()} == {"a": "ready", "b": "stale", "c": "failed"}
    told.unpersist()


def test_an_empty_log(spark):
    told = rv.verdicts(spark.createDataFrame([], LOG))
    assert told.count() == 0 and rv.documents(told).count() == 0 and rv.kept_revisions(told).count() == 0


def test_blobs_are_put_once(spark):
    known = spark.createDataFrame([("2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae", "text/plain", 3)], "blob string, mime string, size bigint")
    new = spark.createDataFrame([(b"foo", "text/plain"), (b"bar", "a"), (b"bar", "b"), (b"", "c"), (None, "d")], "data binary, mime string")
    add, conflicts = rv.put_blobs(known, new, 6)
    assert sorted((bytes(r.data), r.mime, r.size) for r in add.collect()) == [(b"", "c", 0), (b"bar", "a", 3)]
    assert [sorted(r.mimes) for r in conflicts.collect()] == [["a", "b"]]
    with pytest.raises(ValueError):
        rv.put_blobs(known, new, 5)


def test_links_of_the_newest_generation(spark):
    rows = [("p", "s", 1, "c1", "o1"), ("p", "s", 2, "c2", "o1"), ("p", "s", 2, "c2", "o1"), ("p", "t", 1, "c3", "o1"), ("p", "t", 3, None, None), ("q", "s", 1, "c1", "o2")]
    got = rv.live_links(spark.createDataFrame(rows, "profile string, source string, generation int, chunk string, occurrence string"))
    assert sorted((r.profile, r.source, r.chunk) for r in got.collect()) == [("p", "s", "c2"), ("q", "s", "c1")]
