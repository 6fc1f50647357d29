import pytest
from lodestone.functions import convert
from lodestone.functions.text import cut_bytes, excerpt, human_bytes, prefix_words
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "value"), [("2+3*4", "14"), ("2^3^2", "512"), ("-2^2", "-4"), ("50%", "0.5"), ("10 mod 3", "1"), ("0x10+1", "17"), ("1_000*2", "2000"), ("200*10%", "20"), ("1/3", "0.3333333333"), ("5", None), ("1/0", None), ("2*", None), ("(1+2", None), ("a+1", None), ("9^999", None)])
def test_calculator(text, value):
    got = convert.evaluate(text)
    assert (None if got is None else convert.number_format(got)) == value


@pytest.mark.parametrize(("text", "value"), [("72f in c", "22.22222222 c"), ("5'11\" to m", "1.8034 m"), ("5 ft 11 in to cm", "180.34 cm"), ("1h 30m in min", "90 min"), ("1 GB to MiB", "953.6743164 MiB"), ("10 km to mi", "6.213711922 mi"), ("3 m to ft", "9.842519685 ft"), ("1 kg in km", None), ("foo to bar", None)])
def test_units(text, value):
    assert convert.converted(text) == value


def test_zones():
    assert convert.zone_answer("3pm toronto in tokyo", 1772982000) == "2026-03-09 04:00"
    assert convert.zone_answer("difference between london and tokyo", 1768435200) == "+9:00"
    assert convert.clock("15h30") == (15, 30) and convert.clock("12am") == (0, 0) and convert.clock("25:00") is None
    assert convert.zone("nowhere") is None


def test_dispatch():
    assert convert.dispatched("@1700000000", 0) == "2023-11-14 22:13:20 UTC"
    assert convert.dispatched("https://a.b/c", 0) == "https://a.b/c"
    assert convert.dispatched("2+2", 0) == "4" and convert.dispatched("hello", 0) is None


def test_encodings(spark):
    rows = spark.createDataFrame([("a b~*+é",), ("",), ("x" * 100,)], "s string")
    out = rows.select("s", convert.base64_decoded(convert.base64_encoded(F.col("s"))).alias("b"), convert.percent_encoded(F.col("s")).alias("p"), convert.percent_decoded(convert.percent_encoded(F.col("s"))).alias("d")).collect()
    assert out[0].p == "a%20b~%2A%2B%C3%A9" and all(r.d == r.s for r in out) and out[0].b == out[0].s and out[2].b == out[2].s
    bad = spark.createDataFrame([("!!!", "%zz", "0xzz"), ("_-8", "a+b", "0xff")], "b string, p string, h string").select(convert.base64_decoded(F.col("b")).alias("b"), convert.percent_decoded(F.col("p")).alias("p"), convert.hex_literal(F.col("h")).alias("h")).collect()
    assert (bad[0].b, bad[0].p, bad[0].h) == (None, None, None) and bad[1].p == "a+b" and bad[1].h == 255
    assert convert._json('{"b":1,"a":[1, 2]}', None) == '{"b":1,"a":[1,2]}' and convert._json("{", None) is None
    assert convert.fnv1a(b"") == 0xCBF29CE484222325 - (1 << 64)


def test_text_helpers(spark):
    r = spark.range(1).select(cut_bytes(F.lit("aé"), 2).alias("c"), excerpt(F.lit(" a\n b ")).alias("e"), prefix_words(F.lit("alpha beta gamma"), 12).alias("p"), human_bytes(F.lit(1234567)).alias("h"), F.octet_length(excerpt(F.lit("é" * 200))).alias("n")).first()
    assert (r.c, r.e, r.p, r.h, r.n) == ("a", "a b", "alpha beta", "1.2 MB", 183)


def test_marks_and_validators(spark):
    from lodestone.functions import text

    assert text.marked_ranges("Café and café bar", "find cafe kind:pdf bar") == [(0, 4), (9, 4), (14, 3)]
    r = spark.range(1).select(
        text.valid_keyword(F.lit("ab-1")).alias("k"),
        text.valid_keyword(F.lit("A")).alias("k2"),
        text.valid_link(F.lit("https://a.b/c")).alias("u"),
        text.valid_link(F.lit("file:///x")).alias("u2"),
        text.asks_about_calendar(F.lit("> what’s on my calendar today")).alias("c"),
        text.asks_about_calendar(F.lit("schedule a meeting tomorrow")).alias("c2"),
        text.is_private_clip(F.array(F.lit("a"), F.lit("hidden")), ["hidden"]).alias("p"),
    ).first()
    assert tuple(r) == (True, False, True, False, True, False, True)


def test_fuel_rates_and_exponents():
    from lodestone.functions.convert import ZONE_ALIASES, converted, zone

    asked = {
        "10 l/100km to mpg": "23.52145833 mpg",
        "30 mpg to l/100km": "7.840486111 l/100km",
        "30 mpg in km/l": "12.75431122 km/l",
        "0 mpg to km/l": None,
        "1 mbps in kbps": "1000 kbps",
        "8 gb/s in gbps": "64 gbps",
        "1e3 m to km": "1 km",
        "100 sqft to m2": "9.290304 m2",
    }
    assert {t: converted(t) for t in asked} == asked
    assert all(zone(v) for v in ZONE_ALIASES.values()) and zone("New Orleans") == "America/Chicago"
