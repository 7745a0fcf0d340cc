"""Text features of a mail body or post as column expressions. Everything stays
in the row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .numbers import round_exact
from .strings import NOT_WORD_BEFORE, NOT_WS, WS, any_of, count_of, count_terms_in, fill_pattern, strip

_DOT = "<DOT>"

TERM_COUNTS = {
    "llm_trope_word_count": lx.TROPE_WORDS,
    "llm_trope_phrase_count": lx.TROPE_PHRASES,
    "urgency_word_count": lx.URGENCY_TERMS,
    "financial_action_word_count": lx.FINANCIAL_TERMS,
    "causal_connective_count": lx.CAUSAL_TERMS,
    "personal_osint_word_count": lx.PERSONAL_TERMS,
}

TEXT_FEATURES = [
    "sentence_count", "word_count", "burstiness_score", "low_burstiness_flag",
    "llm_trope_word_count", "llm_trope_phrase_count", "prompt_leakage_detected",
    "out_of_band_excuse_count", "urgency_word_count", "financial_action_word_count",
    "urgency_financial_combo", "causal_connective_count", "personal_osint_word_count",
    "personalization_financial_mismatch",
]

PATTERN_FEATURES = {"prompt_leakage_detected", "out_of_band_excuse_count"}
# Features made from the sentence lengths, and what the combined ones are made of.
LENGTH_FEATURES = {"sentence_count", "burstiness_score"}
COMBINED = {
    "urgency_financial_combo": ("urgency_word_count", "financial_action_word_count"),
    "personalization_financial_mismatch": ("personal_osint_word_count", "financial_action_word_count"),
    "low_burstiness_flag": ("burstiness_score",),
}


def _segments(text: Column) -> Column:
    names = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
    # The letters come before the Unicode look-behind, and most texts need neither.
    dotted = any_of([F.contains(text, F.lit(f"{a}.")) for a in lx.ABBREVIATIONS])
    kept = F.when(dotted, F.regexp_replace(text, rf"(?=(?:{names})\.){NOT_WORD_BEFORE}({names})\.", f"$1{_DOT}")).otherwise(text)
    return F.split(kept, rf"(?<=[.!?]){WS}+", -1)


def sentences(text: Column) -> Column:
    parts = F.transform(_segments(text), lambda s: strip(F.replace(s, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    """Words per sentence; blank sentences dropped."""
    lengths = F.transform(_segments(text), lambda s: F.regexp_count(s, F.lit(f"{NOT_WS}+")))
    return F.filter(lengths, lambda n: n > 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[a-zA-Z']+"))


def burstiness(lengths: Column) -> Column:
    """Population deviation / mean of the lengths from integer sums, 3 decimals;
    1.0 with too few sentences."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(lengths, zero, lambda a, n: F.struct(
        (a["s"] + n).alias("s"), (a["q"] + n.cast("long") * n).alias("q")))
    ratio = F.sqrt((F.size(lengths) * sums["q"] - sums["s"] * sums["s"]).cast("double")) / sums["s"]
    return F.when(F.size(lengths) < lx.MIN_SENTENCES, F.lit(1.0)).otherwise(round_exact(ratio, 3))


def leak_flags(lowered: Column) -> list[Column]:
    return [lowered.rlike(fill_pattern(p)) for p, _ in lx.PROMPT_LEAK_PATTERNS]


def excuse_flags(lowered: Column) -> list[Column]:
    return [lowered.rlike(fill_pattern(p)) for p, _ in lx.EXCUSE_PATTERNS]


def term_count_stage(lowered: str) -> dict[str, Column]:
    """Counts over the column named ``lowered``."""
    return {name: count_terms_in(lowered, terms) for name, terms in TERM_COUNTS.items()}


def pattern_stage(lowered: Column) -> dict[str, Column]:
    return {
        "prompt_leakage_detected": any_of(leak_flags(lowered)),
        "out_of_band_excuse_count": count_of(excuse_flags(lowered)),
    }


def structure_stage(text: Column, lengths: Column) -> dict[str, Column]:
    return {
        "sentence_count": F.size(lengths),
        "word_count": word_count(text),
        "burstiness_score": burstiness(lengths),
    }


def combo_stage(get) -> dict[str, Column]:
    money = get("financial_action_word_count") > 0
    return {
        "urgency_financial_combo": (get("urgency_word_count") > 0) & money,
        "personalization_financial_mismatch": (get("personal_osint_word_count") > 0) & money,
        "low_burstiness_flag": get("burstiness_score") < lx.LOW_BURSTINESS,
    }


def _terms_found(lowered: Column, terms: list[str]) -> Column:
    """Terms in sorted order. Each test is generated code, not a loop over an array."""
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in sorted(terms)]))


def _matches(lowered: Column, patterns: list[tuple[str, int]]) -> Column:
    return F.concat(*[
        F.regexp_extract_all(lowered, F.lit(fill_pattern(p)), F.lit(group)) for p, group in patterns])


def found_stage(lowered: Column) -> dict[str, Column]:
    """Per term list the terms that occur, sorted."""
    return {f"_found_{name}": _terms_found(lowered, terms) for name, terms in TERM_COUNTS.items()}


def found_count_stage() -> dict[str, Column]:
    """Counts as sizes of what was found."""
    return {name: F.size(f"_found_{name}") for name in TERM_COUNTS}


def evidence_of_found(lowered: Column) -> Column:
    """MAP<category, ARRAY<match>>: terms in sorted order, regex matches in
    pattern then text order; over the columns of ``found_stage``."""
    return _evidence({name: F.col(f"_found_{name}") for name in TERM_COUNTS}, lowered)


def evidence(lowered: Column) -> Column:
    """The same without a stage before it."""
    return _evidence({name: _terms_found(lowered, terms) for name, terms in TERM_COUNTS.items()}, lowered)


def _evidence(terms: dict[str, Column], lowered: Column) -> Column:
    found = {
        "llm_tropes": F.concat(terms["llm_trope_word_count"], terms["llm_trope_phrase_count"]),
        "prompt_leakage": _matches(lowered, lx.PROMPT_LEAK_PATTERNS),
        "out_of_band_excuses": _matches(lowered, lx.EXCUSE_PATTERNS),
        "urgency": terms["urgency_word_count"],
        "financial": terms["financial_action_word_count"],
        "causal_connectives": terms["causal_connective_count"],
        "personal_osint": terms["personal_osint_word_count"],
    }
    return F.map_from_arrays(F.array(*[F.lit(k) for k in found]), F.array(*found.values()))
