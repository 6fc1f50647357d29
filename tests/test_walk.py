import os

import pytest
from lodestone.sources import files, walk


@pytest.fixture
def tree(tmp_path):
    for name in ["a.md", "b.bin", "p/c.rs", "p/q/d.txt", "p/q/.e.txt", "node_modules/x/y.js", ".git/z.md", "p/id_rsa", "r/f.JSON", "r/é ü.txt"]:
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(name.encode())
    os.symlink(tmp_path / "p", tmp_path / "link")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    return tmp_path


def _names(listing, tree):
    return sorted((r.path[len(str(tree)) + 1 :], r.kind) for r in listing.collect())


def test_walk_lists_supported_files_and_never_opens_excluded_folders(spark, tree):
    found = walk.walk(spark, [str(tree)])
    assert _names(found, tree) == [(n, "file") for n in ["a.md", "p/c.rs", "p/q/d.txt", "r/f.JSON", "r/é ü.txt"]]
    assert walk.is_complete(found)
    opened = {r.path for f in found.inputFiles()[:1] for r in spark.read.parquet(f[: f.index("/round=")]).select("path").collect()}
    assert not [p for p in opened if "/node_modules/" in p or "/.git/" in p]
    texts = {r.path: bytes(r.content) for r in walk.with_content(found).collect()}
    assert texts[str(tree / "p/q/d.txt")] == b"p/q/d.txt" and len(texts) == 5
    docs = {r.title: (r.text, r.bytes, r.extraction) for r in files.documents(walk.with_content(found, files.MAX_TEXT + 1)).collect()}
    assert docs["é ü.txt"] == ("r/é ü.txt", 11, 0)
    assert {bytes(r.content) for r in walk.with_content(found, 3).collect()} == {b"a.m", b"p/c", b"p/q", b"r/f", "r/é".encode()[:3]}


def test_changed_paths_are_looked_at_once(spark, tree):
    targets = [str(tree / x) for x in ["p", "p/q", "p/q/d.txt", "r/f.JSON", "r/none.txt", ".git", "node_modules/x"]] + ["/elsewhere"]
    found = walk.walk(spark, [str(tree)], targets)
    assert _names(found, tree) == [("p/c.rs", "file"), ("p/q/d.txt", "file"), ("r/f.JSON", "file"), ("r/none.txt", "gone")]
    assert {r.path[len(str(tree)) + 1 :]: r.depth for r in found.collect()} == {"p/c.rs": 2, "p/q/d.txt": 3, "r/f.JSON": 2, "r/none.txt": 2}
    with pytest.raises(ValueError):
        walk.walk(spark, [str(tree)], [f"/x/{i}" for i in range(129)])


def test_bounds_leave_holes(spark, tree):
    shallow = walk.walk(spark, [str(tree)], depth=1)
    assert ("p", "too deep") in _names(shallow, tree) and ("p/c.rs", "file") not in _names(shallow, tree)
    assert not walk.is_complete(shallow)
    short = walk.walk(spark, [str(tree)], most=1)
    assert ("p", "limit") in _names(short, tree) and ("a.md", "file") in _names(short, tree) and not walk.is_complete(short)


def test_missing_and_no_roots(spark, tree):
    assert _names(walk.walk(spark, [str(tree / "nothing")]), tree) == [("nothing", "gone")]
    assert walk.walk(spark, []).count() == 0
    assert walk.local_path("file:///a/b") == "/a/b" == walk.local_path("/a/b")
    with pytest.raises(ValueError):
        walk.local_path("hdfs://a/b")
