"""Scalar converters: arithmetic, encodings, epochs, units, clock times."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Callable
from datetime import UTC, datetime
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- arithmetic ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F_]+)|((?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)|(mod\b)|([-+*/^%()×÷−]))")
_ALIKE = {"×": "*", "÷": "/", "−": "-"}


class _Sum:
    """Precedence climbing over tokens; any error is a ValueError."""

    BINARY = {"+": (1, float.__add__), "-": (1, float.__sub__), "*": (2, float.__mul__), "/": (2, float.__truediv__), "mod": (2, math.fmod)}

    def __init__(self, text: str):
        self.tokens: list[float | str] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError("not arithmetic")
            at = m.end()
            if m[1]:
                self.tokens.append(float(int(m[1].replace("_", ""), 16)))
            elif m[2]:
                self.tokens.append(float(m[2].replace("_", "")))
            else:
                self.tokens.append(m[3] or _ALIKE.get(m[4], m[4]))
        self.at = 0
        self.operations = 0

    def peek(self) -> float | str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> float | str:
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self, least: int = 0, depth: int = 0) -> float:
        if depth > 64:
            raise ValueError("nested too deeply")
        left = self.unary(depth)
        while (op := self.peek()) in self.BINARY and self.BINARY[op][0] > least:
            self.take()
            self.operations += 1
            right = self.value(self.BINARY[op][0], depth + 1)
            if op in ("/", "mod") and right == 0:
                raise ValueError("division by zero")
            left = self.BINARY[op][1](left, right)
        return left

    def unary(self, depth: int) -> float:
        if depth > 64:
            raise ValueError("nested too deeply")
        if self.peek() in ("+", "-"):
            self.operations += 1
            sign = -1.0 if self.take() == "-" else 1.0
            return sign * self.unary(depth + 1)
        return self.power(depth)

    def power(self, depth: int) -> float:
        base = self.atom(depth)
        if self.peek() == "^":
            self.take()
            self.operations += 1
            # right-associative; a sign may follow
            result = base ** self.unary(depth + 1)
            if isinstance(result, complex):
                raise ValueError("not real")
            return result
        return base

    def atom(self, depth: int) -> float:
        token = self.peek()
        if token == "(":
            self.take()
            inner = self.value(0, depth + 1)
            if self.peek() != ")":
                raise ValueError("unclosed")
            self.take()
        elif isinstance(token, float):
            inner = self.take()
        else:
            raise ValueError("a number is missing")
        while self.peek() == "%":
            self.take()
            self.operations += 1
            inner /= 100.0
        return inner


def evaluate(text: str | None) -> float | None:
    """Value of an arithmetic expression; None for a bare number, an error or a result that isn't finite."""
    try:
        s = _Sum(text or "")
        value = s.value()
        if s.peek() is not None or not s.operations or not math.isfinite(value):
            return None
        return value
    except (ValueError, OverflowError, ZeroDivisionError):
        return None


def number_format(x: float) -> str:
    """Whole numbers below 1e15 bare; others with up to ten decimals."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    out = f"{x:.10f}".rstrip("0").rstrip(".")
    return "0" if out in ("-0", "") else out


@F.pandas_udf(T.StringType())
def calculated(text: pd.Series) -> pd.Series:
    values = [evaluate(t) for t in text]
    return pd.Series([None if v is None else number_format(v) for v in values], dtype=object)


# --- encodings: JVM-side wherever Spark agrees -------------------------------------------------------


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def sha256_base64(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.unhex(F.sha2(text, 256))), r"[\r\n]", "")


def base64_encoded(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def base64_decoded(text: Column) -> Column:
    """Standard or URL-safe, padding optional, UTF-8 only; null otherwise."""
    plain = F.regexp_replace(F.translate(F.trim(text), "-_", "+/"), "=+$", "")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    good = plain.rlike(r"^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1)
    raw = F.when(good, F.unbase64(padded))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def percent_encoded(text: Column) -> Column:
    """RFC 3986: everything but letters, digits and -._~ is escaped."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(text: Column) -> Column:
    """+ stays; malformed escapes and what isn't UTF-8 give null."""
    good = ~text.rlike(r"%(?![0-9A-Fa-f]{2})")
    raw = F.when(good, F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))
    return F.when(~F.contains(raw, F.lit("�")), raw)


def hex_of(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n.cast("long"))))


def binary_of(n: Column) -> Column:
    return F.concat(F.lit("0b"), F.bin(n.cast("long")))


def hex_literal(text: Column) -> Column:
    """Value of 0x..., null if it is none or exceeds 64 bits."""
    digits = F.regexp_extract(F.lower(F.trim(text)), "^0x([0-9a-f]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)"))


def lone_url(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^https?://\S+$"), F.trim(text))


@F.pandas_udf(T.StringType())
def json_flat(text: pd.Series) -> pd.Series:
    """Compact JSON in the order of its keys; null if it is none."""
    return pd.Series([_json(t, None) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def json_pretty(text: pd.Series) -> pd.Series:
    return pd.Series([_json(t, 2) for t in text], dtype=object)


def _json(text: str | None, indent: int | None) -> str | None:
    def refuse(_: str) -> None:
        raise ValueError("not JSON")

    try:
        return json.dumps(json.loads(text or "", parse_constant=refuse), indent=indent, ensure_ascii=False, separators=None if indent else (",", ":"))
    except (ValueError, RecursionError):
        return None


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits, as a signed number with the same bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def fnv1a_64(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else fnv1a(t.encode()) for t in text], dtype="Int64")


# --- dates ------------------------------------------------------------------------------------------


def epoch_literal(text: Column) -> Column:
    """@digits as a timestamp; 13 digits are milliseconds."""
    digits = F.regexp_extract(F.trim(text), r"^@(-?\d{1,13})$", 1)
    n = F.when(digits != "", digits).cast("long")
    return F.when(F.length(digits) == 13, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def utc_text(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def iso_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_timestamp(text: Column) -> Column:
    """'2026-07-06 04:00:00 +0000' as epoch seconds; null if malformed."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")))


# Abbreviation, city and country aliases beyond the zone database.
ZONE_ALIASES = {
    "utc": "UTC",
    "gmt": "UTC",
    "z": "UTC",
    "et": "America/New_York",
    "est": "America/New_York",
    "edt": "America/New_York",
    "eastern": "America/New_York",
    "ct": "America/Chicago",
    "cst": "America/Chicago",
    "cdt": "America/Chicago",
    "central": "America/Chicago",
    "mt": "America/Denver",
    "mst": "America/Denver",
    "mdt": "America/Denver",
    "mountain": "America/Denver",
    "pt": "America/Los_Angeles",
    "pst": "America/Los_Angeles",
    "pdt": "America/Los_Angeles",
    "pacific": "America/Los_Angeles",
    "cet": "Europe/Paris",
    "cest": "Europe/Paris",
    "bst": "Europe/London",
    "ist": "Asia/Kolkata",
    "jst": "Asia/Tokyo",
    "kst": "Asia/Seoul",
    "aest": "Australia/Sydney",
    "aedt": "Australia/Sydney",
    "hkt": "Asia/Hong_Kong",
    "sgt": "Asia/Singapore",
    "montreal": "America/Toronto",
    "montréal": "America/Toronto",
    "quebec": "America/Toronto",
    "quebec city": "America/Toronto",
    "ottawa": "America/Toronto",
    "nyc": "America/New_York",
    "ny": "America/New_York",
    "new york city": "America/New_York",
    "boston": "America/New_York",
    "washington": "America/New_York",
    "washington dc": "America/New_York",
    "dc": "America/New_York",
    "miami": "America/New_York",
    "atlanta": "America/New_York",
    "philadelphia": "America/New_York",
    "san francisco": "America/Los_Angeles",
    "sf": "America/Los_Angeles",
    "la": "America/Los_Angeles",
    "seattle": "America/Los_Angeles",
    "portland": "America/Los_Angeles",
    "san jose": "America/Los_Angeles",
    "silicon valley": "America/Los_Angeles",
    "las vegas": "America/Los_Angeles",
    "austin": "America/Chicago",
    "dallas": "America/Chicago",
    "houston": "America/Chicago",
    "new orleans": "America/Chicago",
    "calgary": "America/Edmonton",
    "beijing": "Asia/Shanghai",
    "shenzhen": "Asia/Shanghai",
    "guangzhou": "Asia/Shanghai",
    "delhi": "Asia/Kolkata",
    "new delhi": "Asia/Kolkata",
    "mumbai": "Asia/Kolkata",
    "bangalore": "Asia/Kolkata",
    "bengaluru": "Asia/Kolkata",
    "hyderabad": "Asia/Kolkata",
    "chennai": "Asia/Kolkata",
    "osaka": "Asia/Tokyo",
    "kyoto": "Asia/Tokyo",
    "tel aviv": "Asia/Jerusalem",
    "abu dhabi": "Asia/Dubai",
    "hanoi": "Asia/Ho_Chi_Minh",
    "milan": "Europe/Rome",
    "florence": "Europe/Rome",
    "barcelona": "Europe/Madrid",
    "munich": "Europe/Berlin",
    "frankfurt": "Europe/Berlin",
    "hamburg": "Europe/Berlin",
    "geneva": "Europe/Zurich",
    "edinburgh": "Europe/London",
    "manchester": "Europe/London",
    "rio": "America/Sao_Paulo",
    "rio de janeiro": "America/Sao_Paulo",
    "hawaii": "Pacific/Honolulu",
    "uk": "Europe/London",
    "japan": "Asia/Tokyo",
    "france": "Europe/Paris",
    "germany": "Europe/Berlin",
    "italy": "Europe/Rome",
    "spain": "Europe/Madrid",
    "india": "Asia/Kolkata",
    "china": "Asia/Shanghai",
    "korea": "Asia/Seoul",
    "south korea": "Asia/Seoul",
}


def zone(name: str) -> str | None:
    """IANA zone of a city, abbreviation or zone name."""
    plain = " ".join(name.lower().replace("_", " ").split())
    if plain in ZONE_ALIASES:
        return ZONE_ALIASES[plain]
    every = sorted(available_timezones())
    whole = {z.lower().replace("_", " "): z for z in every}
    return whole.get(plain) or next((z for z in every if "/" in z and not z.startswith("Etc") and z.rsplit("/", 1)[1].lower().replace("_", " ") == plain), None)


def clock(text: str) -> tuple[int, int] | None:
    """(hour, minute) of 3pm, 15:30, 15h30, noon, midnight."""
    plain = text.strip().lower().replace(" ", "")
    if plain in ("noon", "midnight"):
        return (12, 0) if plain == "noon" else (0, 0)
    m = re.fullmatch(r"(\d{1,2})(?:[:h](\d{2})?)?(am|pm|a|p)?", plain)
    if not m or not (m[3] or re.search("[:h]", plain)):
        return None
    hour, minute = int(m[1]), int(m[2] or 0)
    if m[3]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if m[3][0] == "p" else 0)
    return (hour, minute) if hour < 24 and minute < 60 else None


def zone_answer(text: str, now: int) -> str | None:
    """'3pm toronto in tokyo', 'time in tokyo', 'tokyo time', 'difference between a and b'."""
    plain = " ".join(text.strip().split())
    m = re.fullmatch(r"(?i)(?:time )?(?:difference|diff) (?:between )?(.+?) (?:and|to) (.+)", plain)
    at = datetime.fromtimestamp(now, UTC)
    if m and (a := zone(m[1])) and (b := zone(m[2])):
        minutes = int((at.astimezone(ZoneInfo(b)).utcoffset() - at.astimezone(ZoneInfo(a)).utcoffset()).total_seconds() // 60)
        sign = "+" if minutes >= 0 else "-"
        return f"{sign}{abs(minutes) // 60}:{abs(minutes) % 60:02d}"
    m = re.fullmatch(r"(?i)(?:time in (.+)|(.+) time)", plain)
    if m and (a := zone(m[1] or m[2])):
        return at.astimezone(ZoneInfo(a)).strftime("%Y-%m-%d %H:%M")
    m = re.fullmatch(r"(?i)(\S+(?: ?[ap]m)?) (.+?) (?:in|to) (.+)", plain)
    if m and (t := clock(m[1])) and (a := zone(m[2])) and (b := zone(m[3])):
        here = at.astimezone(ZoneInfo(a)).replace(hour=t[0], minute=t[1], second=0, microsecond=0)
        return here.astimezone(ZoneInfo(b)).strftime("%Y-%m-%d %H:%M")
    return None


# --- units: one affine factor a unit ----------------------------------------------------------------


def _units() -> dict[str, dict[str, tuple[float, float]]]:
    """dimension -> spelling -> (factor, offset) to the base unit; built from the names of each unit."""
    out: dict[str, dict[str, tuple[float, float]]] = {}

    def add(dimension: str, factor: float, names: str, offset: float = 0.0) -> None:
        for n in names.split(","):
            out.setdefault(dimension, {})[n.strip()] = (factor, offset)

    for factor, names in ((1e-9, "nm,nanometer,nanometers"), (1e-6, "um,micron,microns"), (1e-3, "mm,millimeter,millimeters"), (1e-2, "cm,centimeter,centimeters"), (1, "m,meter,meters,metre,metres"), (1e3, "km,kilometer,kilometers"), (0.0254, "in,inch,inches,\""), (0.3048, "ft,foot,feet,'"), (0.9144, "yd,yard,yards"), (1609.344, "mi,mile,miles"), (1852, "nmi,nautical mile,nautical miles"), (149597870700, "au"), (9460730472580800, "ly,light year,light years")):
        add("length", factor, names)
    for factor, names in ((1e-6, "mg,milligram,milligrams"), (1e-3, "g,gram,grams"), (1, "kg,kilogram,kilograms,kilo,kilos"), (1e3, "t,tonne,tonnes"), (0.028349523125, "oz,ounce,ounces"), (0.45359237, "lb,lbs,pound,pounds"), (6.35029318, "st,stone,stones")):
        add("mass", factor, names)
    for factor, names in ((1e-9, "ns"), (1e-6, "us"), (1e-3, "ms,millisecond,milliseconds"), (1, "s,sec,secs,second,seconds"), (60, "min,mins,minute,minutes,m"), (3600, "h,hr,hrs,hour,hours"), (86400, "d,day,days"), (604800, "w,wk,week,weeks"), (31557600, "y,yr,year,years")):
        add("time", factor, names)
    add("temperature", 1, "k,kelvin")
    add("temperature", 1, "c,°c,celsius", 273.15)
    add("temperature", 5 / 9, "f,°f,fahrenheit", 459.67 * 5 / 9)
    for factor, names in ((1, "b,byte,bytes"), (1e3, "kb,kilobyte,kilobytes"), (1e6, "mb,megabyte,megabytes"), (1e9, "gb,gigabyte,gigabytes"), (1e12, "tb,terabyte,terabytes"), (2**10, "kib"), (2**20, "mib"), (2**30, "gib"), (2**40, "tib"), (0.125, "bit,bits")):
        add("data", factor, names)
    for factor, names in ((1, "mps,m/s"), (1 / 3.6, "kph,km/h,kmh"), (0.44704, "mph"), (1852 / 3600, "kn,kt,knot,knots")):
        add("speed", factor, names)
    for factor, names in ((1e-3, "ml,milliliter,milliliters"), (1e-2, "cl"), (1, "l,liter,liters,litre,litres"), (3.785411784, "gal,gallon,gallons"), (0.946352946, "qt,quart,quarts"), (0.473176473, "pt,pint,pints"), (0.2365882365, "cup,cups"), (0.0295735295625, "floz,fl oz"), (0.01478676478125, "tbsp"), (0.00492892159375, "tsp")):
        add("volume", factor, names)
    for factor, names in ((1, "m2,sqm"), (1e6, "km2,sqkm"), (1e4, "ha,hectare,hectares"), (0.09290304, "sqft,ft2"), (4046.8564224, "acre,acres"), (2589988.110336, "sqmi,mi2")):
        add("area", factor, names)
    for factor, names in ((1, "pa,pascal"), (1e3, "kpa"), (1e5, "bar"), (101325, "atm"), (6894.757293168, "psi"), (133.322387415, "mmhg,torr")):
        add("pressure", factor, names)
    for factor, names in ((1, "j,joule,joules"), (1e3, "kj"), (4.184, "cal"), (4184, "kcal"), (3600, "wh"), (3.6e6, "kwh"), (1055.05585262, "btu")):
        add("energy", factor, names)
    for factor, names in ((1, "watt,watts"), (1e3, "kw"), (745.69987158227, "hp")):
        add("power", factor, names)
    for factor, names in ((1, "deg,°,degree,degrees"), (180 / math.pi, "rad,radian,radians"), (0.9, "grad"), (360, "turn,turns")):
        add("angle", factor, names)
    for factor, names in ((1, "hz,hertz"), (1e3, "khz"), (1e6, "mhz"), (1e9, "ghz"), (1 / 60, "rpm")):
        add("frequency", factor, names)
    for factor, names in ((1, "bps"), (1e3, "kbps"), (1e6, "mbps"), (1e9, "gbps"), (8e6, "mb/s"), (8e9, "gb/s")):
        add("data rate", factor, names)
    # litres on a hundred kilometres; the others are distances on a volume, their inverse
    add("fuel", 1, _HUNDRED)
    add("fuel", 100 * 3.785411784 / 1.609344, "mpg")
    add("fuel", 100, "km/l")
    return out


_HUNDRED = "l per hundred km"
INVERSE = {"mpg", "km/l"}
UNITS = _units()
_PART = re.compile(r"([-+]?\d[\d,]*(?:\.\d+)?(?:e[-+]?\d+)?|[-+]?\.\d+)\s*([^\d\s][^\d]*?)(?=\s*(?:[-+]?[\d.]|$))")


def _reading(name: str, dimension: str | None = None) -> tuple[str, float, float] | None:
    """(dimension, factor, offset) of a spelling; of two readings the earlier dimension wins."""
    plain = name.strip()
    for d, names in UNITS.items():
        if dimension in (None, d):
            found = names.get(plain) or names.get(plain.lower())
            if found:
                return d, *found
    return None


def converted(text: str | None) -> str | None:
    """'5 ft 11 in to cm', '72f in c', \"5'11\\\" to m\", '1h 30m in min' -> '180.34 cm'; None if it is no conversion."""
    plain = re.sub(r"(?i)\bl/100 ?km\b", _HUNDRED, text or "")
    plain = re.sub(r"(?i)\b(km|mi|ft|m)2(?!\d)", r"sq\1", plain)
    m = re.fullmatch(r"(?is)\s*(.+)\s+(?:to|in|as|=)\s+(\D+?)\s*", plain)
    if not m:
        return None
    target = _reading(m[2])
    if not target:
        return None
    source = m[1] + ('"' if re.fullmatch(r"\d+'\s*\d+", m[1]) else "")
    parts = _PART.findall(source)
    if not parts or "".join("".join(p) for p in parts).replace(" ", "") != source.replace(" ", ""):
        return None
    readings = [(float(n.replace(",", "")), u.strip().lower(), _reading(u, target[0])) for n, u in parts]
    alone = len(parts) == 1
    if any(r is None or not alone and (r[2] or u in INVERSE) for _, u, r in readings):
        # m alone may mean minutes where the target is a time
        return None
    if any(u in INVERSE and not n for n, u, _ in readings):
        return None
    base = sum(r[1] / n if u in INVERSE else n * r[1] + r[2] for n, u, r in readings)
    if m[2].strip().lower() in INVERSE:
        if not base:
            return None
        value = target[1] / base
    else:
        value = (base - target[2]) / target[1]
    shown = re.fullmatch(r"(?is).*\s(?:to|in|as|=)\s+(\D+?|l/100 ?km|(?:km|mi|ft|m)2)\s*", text)
    return f"{number_format(float(f'{value:.10g}'))} {shown[1] if shown else m[2].strip()}"


@F.pandas_udf(T.StringType())
def converted_units(text: pd.Series) -> pd.Series:
    return pd.Series([converted(t) for t in text], dtype=object)


def decoded_base64(text: str) -> str | None:
    plain = text.strip().replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True).decode() if plain else None
    except (binascii.Error, UnicodeDecodeError):
        return None


def dispatched(text: str, now: int) -> str | None:
    """The first detector that answers: URL, epoch, base64, zones, units, then arithmetic."""
    detectors: list[Callable[[str], str | None]] = [
        lambda t: t.strip() if re.fullmatch(r"https?://\S+", t.strip()) else None,
        lambda t: datetime.fromtimestamp(int(t.strip()[1:]) / (1000 if len(t.strip()) == 14 else 1), UTC).strftime("%Y-%m-%d %H:%M:%S UTC") if re.fullmatch(r"@\d{1,13}", t.strip()) else None,
        lambda t: decoded_base64(t.strip()[7:]) if t.strip().startswith("base64 ") else None,
        lambda t: zone_answer(t, now),
        converted,
        lambda t: None if (v := evaluate(t)) is None else number_format(v),
    ]
    return next((x for d in detectors if (x := d(text)) is not None), None)


def expanded_link(template: Column, query: Column) -> Column:
    """A quick link with {query} filled in."""
    return F.replace(template, F.lit("{query}"), percent_encoded(query))


def byte_count(text: Column) -> Column:
    """'1.5MiB' as bytes; null if malformed."""
    n = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KkMGT]?i?B)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KkMGT]?i?B)\s*$", 2)
    factor = F.lit(1.0)
    for i, letter in enumerate("KMGT", 1):
        factor = F.when(unit == f"{letter}iB", float(1024**i)).when(F.lower(unit) == f"{letter.lower()}b", float(1000**i)).otherwise(factor)
    return n.try_cast("double") * factor


def model_key(identifier: Column, revision: Column, dimensions: Column) -> Column:
    """JSON array that names an embedding model."""
    quoted = F.to_json(F.array(identifier))
    return F.concat(F.substring(quoted, F.lit(1), F.length(quoted) - 1), F.lit(","), revision.cast("string"), F.lit(","), dimensions.cast("string"), F.lit("]"))
