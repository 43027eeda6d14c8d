"""Cases that an earlier version lost or crashed on: scattered edits, files other than Parquet, vocabularies with rules of their own."""

import random
import types

import pytest

from foliary.llm import edit_fingerprint, ngram_join, tokens
from foliary.llm.common import row_ids, shared_dir
from foliary.llm.line_dedup import dedup_lines


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))


def edited(r: random.Random, text: str, share: float) -> str:
    s = list(text)
    for _ in range(int(len(text) * share)):
        i, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 2:
            del s[i]
        else:
            s[i : i + (kind == 0)] = [r.choice("abcdefghijklmnopqrstuvwxyz ")]
    return "".join(s)


def test_edit_groups_find_scattered_edits(spark):
    r = random.Random(41)
    rows, pairs = [], {}
    for i in range(200):
        share = (0.01, 0.03, 0.05, 0.07, 0.09)[i % 5]
        a = prose(r, r.randrange(45, 110))
        b = edited(r, a, share)
        # the true distance, by the plain recurrence of the exact check
        if 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.9:
            pairs.setdefault(share, []).append(2 * i)
        rows += [(2 * i, a, i), (2 * i + 1, b, i)]
    rows += [(900, None, 0), (901, "", 0), (901, "", 0), (902, "x " * 30000, 0), (902, "x " * 30000, 0), (903, "short", 0), (None, "short", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = edit_fingerprint.edit_groups(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    of = {x.id: x.component_id for x in got}
    assert of[901] == of[900] == 900 and of[902] == 902 and of[903] == of[None] == 903
    for share, firsts in pairs.items():
        assert sum(of[i] == of[i + 1] for i in firsts) >= 0.9 * len(firsts), share
    assert all(of[i] in (i, i - 1) for i in range(400))
    assert edit_fingerprint.edit_groups(docs.limit(0), "doc_id", "text").count() == 0


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("form", ["json", "orc", "parquet"])
def test_lines_of_any_file_format(spark, tmp_path, form):
    line = "the same long line of plain words here"
    spark.createDataFrame([(1, f"{line}\nother"), (2, line), (3, None)], "doc_id long, text string").write.format(form).save(str(tmp_path / form))
    docs = spark.read.format(form).schema("doc_id long, text string").load(str(tmp_path / form))
    rows, rid = row_ids(docs)
    assert rows.select(rid).distinct().count() == 3
    assert {x.doc_id: (x.text, x.n_dropped) for x in dedup_lines(docs).collect()} == {1: (f"{line}\nother", 0), 2: ("", 1), 3: (None, 0)}


def test_vocabularies_with_other_rules_get_whole_texts():
    from pathlib import Path

    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = ["", None, "Two  spaces, THREE   spaces", " lead", "it's 12345 café", prose(r, 200)]
    for path in sorted(Path(tokens.default_path()).parent.glob("*.json")):
        enc = tokens.Encoder(str(path))
        assert enc.cuttable == (path.name == tokens.VOCABULARY)
        whole = Tokenizer.from_file(str(path))
        for _ in range(2):  # with and without remembered words
            assert [x.tolist() for x in enc.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_that_come_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    enc = tokens.Encoder(tokens.default_path())
    r, learnt, learn = random.Random(7), [], enc._learn_plain
    monkeypatch.setattr(enc, "_learn_plain", lambda words: (learnt.extend(words), learn(words)))
    texts = [f"head common often. {prose(r, 30)} (common" for _ in range(12)]
    got = [enc.encode([t], 2)[0].tolist() for t in texts]
    assert got == [enc.model.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [learnt.count(w) for w in ("common", "often", "(common")] == [1, 1, 1]
    assert len(enc.known) + len(enc.older) < 120


def test_many_rows_without_an_id_link(spark):
    r = random.Random(6)
    text = prose(r, 80)
    rows = [(None, f"{text} {w}") for w in ("one", "two", "three")] * 20 + [(7, text), (8, prose(r, 80)), (None, None)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert sum(x.component_id == 7 for x in got) == 61 and sum(x.kept for x in got) == 3


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return types.SimpleNamespace(conf={}, sparkContext=context)

    assert shared_dir(session("local[4]"), "x")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master), "x")
