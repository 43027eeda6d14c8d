"""Ignore globs against fnmatch by segments, exemption by front matter, and the listing of a tree."""

import fnmatch
import os

import pytest
from pyspark.sql import functions as F

from foliary.functions import ignore
from foliary.functions import markdown as md
from foliary.sources import vault

PATHS = ["a.md", "A.MD", "drafts/a.md", "x/drafts/b.md", "drafts", "x/a.md", "x/y/z.txt", "x/keep.md", "b[1].md", "notes/2024/q1.md", "notes/2024", "notes", "a\\b.md", "/lead/a.md", "x-y/z.md", "ab.md", ".hidden/a.md", "notes2/a.md", "a&b.md", ""]
FILES = [["drafts/"], ["drafts"], ["*.md", "!keep.md"], ["/x/*.md"], ["x/*"], ["x/**/z.txt"], ["notes/2024/"], ["notes/2024"], ["?.md"], ["[ab].md"], ["[!a].md"], ["b[[]1].md"], ["# no", "", "  ", "!"], ["*", "!x/", "!x/*"], ["**/z.txt"], ["a&b.md"], ["n*s/*"], ["[", "x[y"]]


def plain(path, lines, is_dir):
    """The rule for one path, segment by segment."""
    path = path.replace("\\", "/").strip("/").lower()
    verdict = False
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        ignore_it = not line.startswith("!")
        line = line.lstrip("!").strip() if not ignore_it else line
        if not line or not path:
            continue
        folder = line.endswith("/")
        name = line.rstrip("/").lower()
        *above, last = path.split("/")
        if "/" in name:
            name = name.lstrip("/")
            hit = fnmatch.fnmatchcase(path, name) or path.startswith(name + "/") or folder and path == name
        else:
            hit = any(fnmatch.fnmatchcase(p, name) for p in above) or fnmatch.fnmatchcase(last, name) and (is_dir or not folder)
        verdict = ignore_it if hit else verdict
    return verdict


@pytest.mark.parametrize("is_dir", [False, True])
def test_globs_match_as_segments_and_paths(spark, is_dir):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, path string").coalesce(1)
    got = df.orderBy("i").select(*[ignore.is_ignored(F.col("path"), lines, is_dir).alias(f"c{k}") for k, lines in enumerate(FILES)]).collect()
    for p, row in zip(PATHS, got, strict=True):
        for lines, verdict in zip(FILES, row, strict=True):
            assert verdict == plain(p, lines, is_dir), (p, lines)


def test_front_matter_exempts_by_keys_and_tags(spark):
    texts = ["---\nprivate: yes\n---\n", "---\nPrivate: no\n---\n", "---\ntags: [#Secret, b]\n---\n", "---\ntags: b\n---\n", "---\nrag: off\n---\n", "plain", "---\nprivate: [yes, no]\n---\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("l", md.lines_of(F.col("t")))
    found = F.when(md.front_size(F.col("l")) > 0, md.front_matter(F.col("l"), md.front_size(F.col("l"))))
    got = [r[0] for r in df.orderBy("i").select(md.exempt(found, ["PRIVATE"], ["#secret"])).collect()]
    assert got == [True, False, True, False, True, False, False]


def test_listing_prunes_and_tells_what_it_could_not_read(spark, tmp_path):
    for p in ("a.md", "b.TXT", "c.pdf", "~d.md", "e.md.tmp", "x/f.md", "x/deep/g.md", "old/h.md", "old/keep.md", ".git/i.md", "skip.md"):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text(p)
    lines = ["old/", "skip.md"]
    got = vault.scan(spark, str(tmp_path), lines)
    assert {r.path: r.size for r in got.files.collect()} == {"a.md": 4, "b.TXT": 5, "x/f.md": 6, "x/deep/g.md": 11}
    assert got.complete and [r.path for r in got.pruned.collect()] == ["old"] and got.unreadable.count() == 0
    every = vault.scan(spark, f"file://{tmp_path}", lines, with_ignored=True)
    assert {r.path: r.ignored for r in every.files.collect()} == {"a.md": False, "b.TXT": False, "x/f.md": False, "x/deep/g.md": False, "old/h.md": True, "old/keep.md": True, "skip.md": True}
    assert not vault.scan(spark, str(tmp_path), lines, levels=1).complete
    gone = vault.scan(spark, f"{tmp_path}/nowhere")
    assert not gone.complete and gone.files.count() == 0 and gone.unreadable.count() == 1
