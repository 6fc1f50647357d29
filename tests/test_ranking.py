from lodestone.functions import usage
from lodestone.operators import ranking
from pyspark.sql import functions as F


def test_fuzzy_scores_and_places():
    assert ranking.fuzzy_match("x", "Xcode") == (36, [0])
    assert ranking.fuzzy_match("x", "Firefox")[0] == 16
    assert ranking.fuzzy_match("desktop", "Desktop") == (192, list(range(7)))
    assert ranking.fuzzy_match("vsc", "Visual Studio Code")[1] == [0, 7, 14]
    assert ranking.fuzzy_match("zz", "Safari") is None
    assert ranking.fuzzy_match("", "a") == (0, [])
    assert ranking.fuzzy_match("S", "safari") is None


def test_tiers(spark):
    rows = spark.createDataFrame([("notes.md", "notes", 5), ("Notes", "notes", 5), ("notes2", "notes", 4), ("my-notes", "notes", 3), ("keynotes", "notes", 2), ("n o", "notes", 1), ("x", " ", 1)], "name string, query string, expected int")
    assert all(r.t == r.expected for r in rows.withColumn("t", ranking.tier(F.col("name"), F.col("query"))).collect())


def test_noise(spark):
    noisy = ["/System/x", "/usr/bin/a", "/Users/a/Library/x", "/Users/a/p/node_modules/b.js", "/Users/a/.git/config", "/Users/a/go/pkg/m.go", "/Applications/A.app/Contents/x"]
    clean = ["/Users/a/notes.md", "/Users/a/.zshrc", "/Users/a/going/pkg.md", "/Applications/A.app"]
    rows = spark.createDataFrame([(p, True) for p in noisy] + [(p, False) for p in clean], "path string, expected boolean")
    assert [r.path for r in rows.withColumn("n", ranking.is_noise(F.col("path"))).where("n <> expected").collect()] == []


def test_key_orders_a_persons_files_first(spark):
    rows = spark.createDataFrame([(1, "Desktop", "/Users/a/Desktop"), (2, "Desktop", "/Users/a/p/Desktop"), (3, "desktop.c", "/usr/x/desktop.c"), (4, "Podman Desktop", "/opt2/Podman Desktop")], "id long, name string, path string")
    key = ranking.key(F.col("name"), F.col("path"), F.lit(False), F.lit(0), F.lit(0), F.lit("desktop"), "/Users/a")
    assert [r.id for r in rows.orderBy(F.desc(key)).collect()] == [1, 2, 4, 3]


def test_rank_names_boosts_and_breaks_ties_by_id(spark):
    names = spark.createDataFrame([(1, "Safari"), (2, "Settings"), (3, "Slack"), (4, "Xcode")], "id long, name string")
    asked = spark.createDataFrame([(1, "s"), (2, "")], "query_id long, text string")
    used = spark.createDataFrame([(3, 5.0)], "id long, used double")
    out = ranking.rank_names(names, asked, 3, used).orderBy("query_id", "place").collect()
    assert [r.id for r in out if r.query_id == 1] == [3, 1, 2]
    assert [r.id for r in out if r.query_id == 2] == [1, 2, 3]


def test_decay_and_boost(spark):
    day = 86400
    rows = spark.createDataFrame([(1, 0), (1, 14 * day), (2, 28 * day + 5)], "id long, at long")
    got = {r.id: r.s for r in rows.groupBy("id").agg(usage.decayed_count(F.col("at"), F.lit(28 * day)).alias("s")).collect()}
    assert abs(got[1] - 0.75) < 1e-12 and got[2] == 1.0
    b = spark.range(1).select(usage.boost(F.lit(0.0)).alias("z"), usage.boost(F.lit(3.0)).alias("h"), usage.boost(F.lit(1e9)).alias("m")).first()
    assert b.z == 1.0 and abs(b.h - 1.3) < 1e-12 and b.m < 1.6


def test_lanes(spark):
    a = spark.createDataFrame([("p", 0), ("q", 1)], "id string, position int")
    b = spark.createDataFrame([("q", 0), ("r", 1)], "id string, position int")
    assert [(r.id, r.lane) for r in ranking.merged_lanes(a, b).collect()] == [("p", 0), ("q", 0), ("r", 1)]


def test_welcome(spark):
    apps = spark.createDataFrame([(i, float(i)) for i in range(8)], "id long, used_score double")
    files = spark.createDataFrame([(100 + i, i) for i in range(2)], "id long, last_used long")
    kinds = [r.kind for r in ranking.welcome(apps, files, 6).collect()]
    assert kinds.count("app") == 4 and kinds.count("file") == 2
