import pytest
from lodestone.operators import filters
from lodestone.operators.filters import Age, FilterError, Size, parse
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("report", {"name": "report"}),
        ("kind:PDF size:>5MB modified:week annual report", {"name": "annual report", "kind": "pdf", "size": Size(">", 5_000_000), "modified": Age("within", 7)}),
        ("size:1.5KiB", {"size": Size("=", 1536)}),
        ("used:>180d", {"used": Age("older", 180)}),
        ("a:b c", {"name": "a:b c"}),
        ('"kind:pdf" x', {"name": "kind:pdf x"}),
        (r'"say \"hi\"" now', {"name": 'say "hi" now'}),
        ("modified:yesterday", {"modified": Age("yesterday")}),
    ],
)
def test_accepts(text, expected):
    got = parse(text)
    assert {k: v for k, v in vars(got).items() if v} == expected


@pytest.mark.parametrize("text", ["kind:", "kind:a/b", "kind:pdf kind:doc", "size:", "size:x", "size:.5MB", "size:1.0000001MB", "size:0.5B", "size:99999999999GB", "modified:0d", "modified:36501d", "modified:soon", "used:1d used:2d", '"open', "x" * 4097, "a\0b"])
def test_refuses(text):
    with pytest.raises(FilterError):
        parse(text)


def test_ages_are_whole_local_days(spark):
    now = 1_700_000_000  # 2023-11-14 22:13:20 UTC
    today = 1_699_920_000
    rows = spark.createDataFrame([(t,) for t in (today, today - 1, today - 86400, today - 86401)], "t long")
    count = lambda age: rows.where(filters.age_predicate(F.col("t"), age, now)).count()
    assert [count(Age("today")), count(Age("yesterday")), count(Age("within", 1)), count(Age("older", 1))] == [1, 2, 3, 1]
    assert filters.midnight(now, "Asia/Tokyo") == 1_699_974_000


def test_scopes(spark):
    rows = spark.createDataFrame([("/a/b.md",), ("/a",), ("/ab/c",), ("/a/x/y",), ("/z",)], "path string")
    found = lambda *a: {r.path for r in rows.where(filters.scope_predicate(F.col("path"), *a)).collect()}
    assert found(["/a"]) == {"/a", "/a/b.md", "/a/x/y"}
    assert found(["/a"], ["/a/x"]) == {"/a", "/a/b.md"}
    assert found([]) == set()
    with pytest.raises(FilterError):
        filters.scope_predicate(F.col("path"), ["relative"])


def test_nested_paths(spark):
    assert filters.collapsed_paths(["/a/b", "/a", "/a-b", "/c/d", "/c/d/e"]) == ["/a", "/a-b", "/c/d"]
    rows = spark.createDataFrame([("/a",), ("/a/b",), ("/a-b",), ("/c/d",)], "path string")
    assert {r.path for r in filters.without_descendants(rows).collect()} == {"/a", "/a-b", "/c/d"}


def test_content_filters(spark):
    rows = spark.createDataFrame([("/a.md", 10), ("/b.pdf", 10), ("/c.md", 3)], "path string, bytes long").withColumn("t", F.lit(0))
    names = lambda q: {r.path for r in rows.where(filters.content_predicate(parse(q), F.col("path"), F.col("bytes"), F.col("t"), 0)).collect()}
    assert names("kind:notes size:>5") == {"/a.md"}
    assert names("kind:documents") == {"/b.pdf"}
    for refused in ("kind:folder", "used:today"):
        with pytest.raises(FilterError):
            names(refused)
    assert rows.where(filters.extension_predicate(F.col("path"), ["md", "*"])).count() == 0


def test_phrases():
    assert filters.rewritten("documents about  tax") == ":content kind:documents tax"
    assert filters.rewritten("Ask my notes when") == ">docs when"
    assert filters.rewritten("plain words") is None


def test_exclusions(spark):
    rows = spark.createDataFrame([("/a/.git/x",), ("/a/node_modules/x.js",), ("/a/id_rsa",), ("/a/k.pem",), ("/a/B.app/x",), ("/a/ok.md",)], "path string")
    assert [r.path for r in rows.where(~filters.excluded(F.col("path"))).collect()] == ["/a/ok.md"]


def test_eligible_paths_with_code_roots(spark):
    rows = [("/a/x.md", True), ("/a/x.rs", False), ("/code/x.rs", True), ("/code/Makefile", True), ("/code/x.json", False), ("/codes/x.rs", False), ("/a/x.PDF", True), ("/a/Makefile", False), (None, False)]
    paths = spark.createDataFrame(rows, "path string, expected boolean")
    assert [r.path for r in paths.withColumn("got", filters.eligible_path(F.col("path"), ["/code"])).where("not (got <=> expected)").collect()] == []
