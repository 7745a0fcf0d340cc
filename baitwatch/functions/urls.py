"""URL features as column expressions.

The features are written once as stages ``getter -> {name: column}``. They run
over a URL column (``with_url_features``) or inside an array of URLs in one row
(``url_structs``), so a mail with many links needs neither explode nor shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .domains import Getter, host_of, suffix_stages
from .strings import closed, count_char, one_of, sql_array, ws_class_without

_URL_CHARS = ws_class_without("<>\"'")
URL_PATTERN = rf"(https?://{_URL_CHARS}+|www\.{_URL_CHARS}+)"

NUMERIC_FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_at_symbols", "num_digits",
    "subdomain_level", "path_level", "impersonation_keyword_count",
    "num_percent_encoded_chars",
]
BOOLEAN_FEATURES = [
    "is_ip_address", "is_shortened", "suspicious_tld", "has_at_symbol_trick",
    "has_double_slash_in_path", "has_email_in_url", "is_typosquat",
    "has_homograph_chars",
]

Stage = Callable[[Getter], dict[str, Column]]


def find_urls(text: Column) -> Column:
    """URLs in order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(1))


def path_of(url: Column) -> Column:
    """Path without query, fragment and parameters of the last segment; a URL
    without scheme is read as http."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    path = F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.substring_index(path, "/", -1)
    return F.concat(F.left(path, F.length(path) - F.length(last)), F.substring_index(last, ";", 1))


def scheme_of(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.when(scheme == "", F.lit("http")).otherwise(scheme)


def parts_stage(get: Getter) -> dict[str, Column]:
    return {"host": host_of(get("url")), "path": path_of(get("url"))}


def lexical_stage(get: Getter) -> dict[str, Column]:
    url = get("url")
    sub = get("subdomain")
    return {
        "url_length": F.length(url),
        "num_dots": count_char(url, "."),
        "num_hyphens": count_char(url, "-"),
        "num_at_symbols": count_char(url, "@"),
        "num_digits": F.regexp_count(url, F.lit(r"\p{Nd}")),
        "num_percent_encoded_chars": count_char(url, "%"),
        "subdomain_level": F.when(sub == "", F.lit(0)).otherwise(count_char(sub, ".") + 1),
        "path_level": count_char(get("path"), "/"),
    }


def flag_stage(get: Getter) -> dict[str, Column]:
    url, path = get("url"), get("path")
    # One character on either side decides as well as a whole run would, and
    # keeps the search linear on very long links.
    before = r"[A-Za-z0-9._%+\-]"
    return {
        "has_https": F.lower(url).startswith("https://"),
        "is_shortened": one_of(get("full_domain"), lx.SHORTENER_DOMAINS),
        "suspicious_tld": one_of(get("suffix"), lx.SUSPICIOUS_TLDS),
        "has_at_symbol_trick": url.contains("@"),
        "has_double_slash_in_path": path.contains("//"),
        "has_email_in_url": (
            url.rlike(rf"{before}%40[A-Za-z0-9.\-]")
            | url.rlike("email=[^&]*%40")
            | path.rlike(rf"{before}@[A-Za-z0-9.\-]+\.[A-Za-z]{{2}}")
        ),
        "has_homograph_chars": url.rlike(r"[^\x00-\x7F]"),
    }


def impersonation_stage(get: Getter) -> dict[str, Column]:
    sub, dom = get("subdomain"), get("domain")
    return {"impersonation_keyword_count": F.size(F.filter(
        sql_array(lx.URL_IMPERSONATION_KEYWORDS), lambda k: sub.contains(k) | dom.contains(k)))}


def is_typosquat(full_domain: Column, known: Iterable[str] = tuple(lx.KNOWN_ENTITY_DOMAINS),
                 max_distance: int = lx.TYPOSQUAT_MAX_DISTANCE, skip_known: bool = False) -> Column:
    """A known brand stapled to another word by a hyphen, or one within
    ``max_distance`` edits. Brand bases close to each other flag each other;
    ``skip_known`` turns that off."""
    known = list(known)
    base = F.substring_index(full_domain, ".", 1)
    words = F.split(base, "-", -1)
    candidates = F.array_append(words, base)
    brands = dict.fromkeys(k.split(".")[0] for k in known)

    def near(word: Column, brand: Column) -> Column:
        return (word != "") & F.levenshtein(word, brand, max_distance).between(1, max_distance)

    squat = F.exists(sql_array(brands), lambda b: (base != b) & (
        F.array_contains(words, b) | F.exists(candidates, lambda w: near(w, b))))
    return squat & ~one_of(full_domain, known) if skip_known else squat


def typosquat_stage(get: Getter) -> dict[str, Column]:
    return {"is_typosquat": is_typosquat(get("full_domain"))}


def url_stages(suffixes: Iterable[str] | None = None) -> list[Stage]:
    return [parts_stage, *suffix_stages(suffixes),
            lexical_stage, flag_stage, impersonation_stage, typosquat_stage]


def with_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage(F.col))
    return df


def with_url_features(df: DataFrame, url_col: str = "url",
                      suffixes: Iterable[str] | None = None) -> DataFrame:
    """Add every per-URL feature to a table with one URL per row."""
    out = df if url_col == "url" else df.withColumn("url", F.col(url_col))
    out = with_stages(out, url_stages(suffixes)).drop("rest")
    return closed(out, {c: F.col(c) for c in out.columns if c not in df.columns})


def _extended_by(stage: Stage, names: list[str]) -> Callable[[Column], Column]:
    """Struct -> the same struct with the fields of one more stage, whose names
    are added to ``names``."""

    def extend(s: Column) -> Column:
        old = list(names)
        new = stage(lambda n: s[n])
        names.extend(new)
        return F.struct(*[s[n].alias(n) for n in old], *[c.alias(n) for n, c in new.items()])

    return extend


def url_structs(urls: Column, suffixes: Iterable[str] | None = None,
                stages: list[Stage] | None = None) -> Column:
    """ARRAY<STRING> of URLs -> ARRAY<STRUCT> with every per-URL feature."""
    names = ["url"]
    arr = F.transform(urls, lambda u: F.struct(u.alias("url")))
    for stage in url_stages(suffixes) if stages is None else stages:
        arr = F.transform(arr, _extended_by(stage, names))
    return arr


def summarise(structs: Column) -> dict[str, Column]:
    """Per-mail features from the array: worst value, any flag, all HTTPS."""
    out = {"num_urls": F.size(structs)}
    for n in NUMERIC_FEATURES:
        out[n] = F.coalesce(F.array_max(structs[n]), F.lit(0))
    for n in BOOLEAN_FEATURES:
        out[n] = F.coalesce(F.array_max(structs[n]), F.lit(False))
    out["has_https"] = F.coalesce(F.array_min(structs["has_https"]), F.lit(True))
    return out
