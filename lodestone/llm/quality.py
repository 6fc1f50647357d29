"""Rule bitmask ledger, in DataFrame functions only.

Each text is measured once; every rule becomes one bit of ``fail_bits`` next to the measurements. A policy
is a named version with a mask of rules, so applying it, comparing versions and computing ablations are
bit operations on the ledger; no text is read again.

Defined cases: a null text has no words and fails the base rules like an empty one; texts of any length are
measured whole; repeated rows give repeated results; an empty table gives no rows; columns other than doc_id and
text are ignored, but the ledger's own columns replace others of their names (``keep_good`` changes no column).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added."""
    zero = F.lit(0).cast("long")
    out = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("_w", F.split(F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = (
        out.withColumn("n_words", F.when(F.element_at("_w", 1) == "", zero).otherwise(F.size("_w").cast("long")))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    )
    out = out.withColumn("_g", F.when(F.col("n_words") >= 3, _grams("_w")))
    # only texts in which some hash comes twice pay for their windows' words, which decide
    twice = F.size(F.array_distinct("_g")) < F.size("_g")
    out = out.withColumn("_p", F.when(twice, F.sort_array(F.transform(_windows("_w"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_r", F.when(F.col("_p").isNotNull(), _repeats("_p")))
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_r").isNotNull(), _covered("_r")), zero)).drop("_t", "_w", "_l", "_g", "_p", "_r")


def _triples(words: str, of: Callable[[Column], Column]) -> Column:
    """``of`` the 3 words from each position on; the last two positions have none."""
    a, b, c = F.col(words).alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c")
    return F.slice(F.transform(F.arrays_zip(a, b, c), of), F.lit(1), F.size(words) - 2)


def _grams(words: str) -> Column:
    return _triples(words, lambda x: F.xxhash64(x))


def _windows(words: str) -> Column:
    """The windows as texts; words hold no blank, so one blank between them keeps different windows apart."""
    return _triples(words, lambda x: F.concat_ws(" ", x.a, x.b, x.c))


def _repeats(placed: str) -> Column:
    """Ascending places of windows that come twice or more: equal neighbours in the order of (window, place)."""
    after = F.slice(placed, F.lit(2), F.size(placed)).alias("y")
    before = F.concat(F.array(F.lit(None).cast("struct<h:string,i:int>")), F.col(placed)).alias("z")
    same = F.filter(F.arrays_zip(F.col(placed).alias("x"), after, before), lambda p: p.x.h.isNotNull() & (p.x.h.eqNullSafe(p.y.h) | p.x.h.eqNullSafe(p.z.h)))
    return F.sort_array(F.transform(same, lambda p: p.x.i))


def _covered(at: str) -> Column:
    """Words under the windows at these places; each covers up to the next, three at most."""
    steps = F.zip_with(F.col(at), F.slice(at, F.lit(2), F.size(at)), lambda i, j: F.least(F.lit(3), F.coalesce(j - i, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` is set where ``fails`` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


#: Bits are never reused; a changed rule takes a new one.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "duplicate_lines", "n_dup_lines > 10 and 10 * n_dup_lines > 3 * n_lines_with_words"),
    Rule(6, "some_repetition", "100 * n_repeat_words > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the filter: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("web-1", (*BASE.rules, "symbols", "short_words", "long_words", "duplicate_lines")),
    Policy("strict-1", tuple(r.name for r in RULES)),
)
PRODUCTION = POLICIES[1]


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measurements and ``fail_bits`` (bigint) added; every rule is evaluated once."""
    out = measured(docs).withColumn("n_lines_with_words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("long"))
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def verdicts(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with base_failed and the policy's verdict ``kept``; null verdicts cannot occur."""
    base = ~passes(BASE)
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail it alone, and that the policy rejects.

    The ledger shrinks to one row per distinct bit pattern first; the rest are bit operations on those.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("docs"))
    table = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for p in policies for r in RULES if r.name in p.rules])
    each = patterns.select("fail_bits", "docs", F.explode(table).alias("x")).select("docs", "x.*", F.col("fail_bits").bitwiseAND(F.col("x.mask")).alias("hit"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("docs"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(n(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("failed"), n(F.col("hit") == F.col("bit")).alias("failed_alone"), n(F.col("hit") != 0).alias("rejected"))


def keep_good(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """docs that pass; columns unchanged."""
    n = len(docs.columns)
    at = {c: i for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*[f"c{i}" for i in range(n)]).withColumn("text", F.col(f"c{at['text']}").cast("string"))
    # the row number keeps the optimizer from copying the measurements' expressions into a pushed-down filter
    rows = verdicts(plain, policy).withColumn("_row", F.monotonically_increasing_id())
    return rows.where("kept and _row >= 0").select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
