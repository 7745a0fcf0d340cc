"""Quality rules kept as a bitmask ledger: every rule is evaluated once, its failure
is a bit beside the measurements, and policies and ablations read only the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import SEPARATORS, SEPARATOR_RUN

# Words of one window in the repeated-window measure.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (over the measurements) is true; bit numbers are for life."""

    name: str
    bit: int
    fails: str


# Fixed rules of the ledger. The first two are the base; the others are lenient
# bounds against tables, markup and boilerplate.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > word_chars"),
    Rule("repeated_lines", 3, "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", 4, "word_chars > 30 * n_words"),
    Rule("short_words", 5, "2 * word_chars < 3 * n_words"),
)
# Versioned policies: the rules in force.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "short_words"),
}
BASE = POLICIES["v1"]


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def words_array(text: Column) -> Column:
    """Words of a text, an empty array without any."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_RUN))


def _window_hashes(words: Column) -> Column:
    return F.when(
        F.size(words) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(1))),
                    lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    )


def _covered(ordered: Column) -> Column:
    """Words in windows whose hash occurs twice or more. ``ordered`` holds (hash,
    place) by hash: the places beside an equal hash are kept, and the steps between
    them added, a window at most."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    sides = F.arrays_zip(ordered.alias("x"), F.concat(none, ordered).alias("p"),
                         F.concat(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), none).alias("n"))
    same = lambda z, k: F.coalesce(z["x"]["h"] == z[k]["h"], F.lit(False))
    marked = F.filter(sides, lambda z: same(z, "p") | same(z, "n"))
    return F.aggregate(
        F.sort_array(F.transform(marked, lambda z: z["x"]["i"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame) -> DataFrame:
    """All measurements of every text, beside the untouched row in ``row``. Null
    counts as an empty text: all measurements are 0. The last step gives each row as
    an array of one struct: filters on measurements stay above it, else Catalyst would
    copy the computation into them, down into the loops over words."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    dense = F.length(F.translate(text, SEPARATORS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    split = rows.select(
        "row", words_array(F.col("row.text")).alias("words"), lines.alias("lines"), dense.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    hashed = split.select("row", "lines", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
                          _window_hashes(F.col("words")).alias("hashes"))
    ordered = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = hashed.select("row", "lines", "word_chars", "n_symbols", "n_words", ordered.alias("ordered"))
    repeats = F.when(F.col("ordered").isNotNull(), _covered(F.col("ordered")))
    out = {
        "row": F.col("row"), "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(repeats, F.lit(0)).cast("long")}
    one = sorted_.select(F.explode(F.array(F.struct(*[c.alias(k) for k, c in out.items()]))).alias("m"))
    return one.select(*[f"m.{k}" for k in out])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``row`` (the input as it is), the measurements and
    ``bits``, the failures. Needs a ``text`` column; repeated rows stay repeated, an
    empty table gives an empty ledger. No shuffle."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
    return measure(docs).withColumn("bits", bits)


def rejected_by(policy: str, bits: Column | str = "bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a rule of the policy failed."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) != 0


def ablations(entries: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows it fails (``n_failed``), rows only it rejects
    (``n_alone``, kept again without the rule), and rows rejected in all. Reads
    nothing but counts of distinct bitmasks."""
    mask = mask_of(POLICIES[policy], rules)
    counts = entries.groupBy("bits").agg(F.count("*").alias("n"))
    ruled = counts.withColumn("rule", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("name"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for r in rules if r.name in POLICIES[policy]])))
    hit = F.col("bits").bitwiseAND(F.lit(mask))
    return ruled.groupBy(F.col("rule.name").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("rule.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("rule.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"))


def keep(docs: DataFrame, policy: str) -> DataFrame:
    """Rows no rule of the policy rejects, with the columns of the input."""
    return ledger(docs).where(~rejected_by(policy)).select("row.*")
