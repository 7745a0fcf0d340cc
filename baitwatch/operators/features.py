"""Mail table -> one wide feature row per mail, in a single narrow pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers as H
from ..functions import lexicons as lx
from ..functions import text as X
from ..functions import urls as U
from ..functions.mime import attachment_names
from ..functions.strings import closed

URL_FEATURES = ["num_urls", *U.NUMERIC_FEATURES, *U.BOOLEAN_FEATURES, "has_https"]
CATEGORICAL = ["spf_result", "dkim_result", "dmarc_result"]


def with_text_features(df: DataFrame, text_col: str, names: Iterable[str] = X.TEXT_FEATURES, matches: bool = False) -> DataFrame:
    """Add the text features in ``names`` (all 14 by default) and, on demand, the map
    ``text_matches``. Only the stages that these need are built. The lowered text and
    the sentence lengths are projections of their own, and with matches the terms found
    are a stage of which counts and matches are both made: each text is searched once."""
    text, names = F.col(text_col), list(names)
    unknown = set(names) - set(X.TEXT_FEATURES)
    if unknown:
        raise ValueError(f"unknown text features: {sorted(unknown)}")
    wanted = set(names).union(*[X.COMBINED.get(n, ()) for n in names])
    low, first = F.col("_lowered"), {}
    if matches or wanted & {*X.TERM_COUNTS, *X.PATTERN_FEATURES}:
        first["_lowered"] = F.lower(text)
    if wanted & X.LENGTH_FEATURES:
        first["_lengths"] = X.sentence_lengths(text)
    df = df.withColumns(first)
    if matches:
        df = df.withColumns(X.found_stage(low))
    stages = {**X.structure_stage(text, F.col("_lengths")), **(X.found_count_stage() if matches else X.term_count_stage("_lowered")),
              **X.pattern_stage(low)}
    df = df.withColumns({n: c for n, c in stages.items() if n in wanted})
    df = df.withColumns({n: c for n, c in X.combo_stage(F.col).items() if n in wanted})
    closing = {n: F.col(n) for n in names} | ({"text_matches": X.evidence_of_found(low)} if matches else {})
    return closed(df, closing, drop={*first, *(X.found_stage(low) if matches else ()), *wanted} - set(names))


def with_url_structs(df: DataFrame, text_col: str, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Add ``urls``: every link of the text with its features, in one array."""
    return (df.withColumn("_found", U.find_urls(F.col(text_col)))
            .withColumn("urls", U.url_structs(F.col("_found"), suffixes)).drop("_found"))


def with_url_summary(df: DataFrame, text_col: str, suffixes: Iterable[str] | None = None) -> DataFrame:
    df = with_url_structs(df, text_col, suffixes)
    found = {**U.summarise(F.col("urls")), "url_domains": F.col("urls.full_domain")}
    return closed(df, found, drop=["urls"])


def with_header_features(df: DataFrame, raw_col: str, url_domains_col: str | None = None) -> DataFrame:
    """Add the header features; keep ``from_addr``, ``from_name``, ``from_domain``."""
    before = df.columns
    df = df.withColumn("head", H.header_block(F.col(raw_col)))
    df = U.with_stages(df, H.header_stages())
    mismatch = (H.sender_url_mismatch(F.col("from_domain"), F.col(url_domains_col))
                if url_domains_col else F.lit(False))
    df = df.withColumn("sender_url_domain_mismatch", mismatch)
    names = ["from_name", "from_addr", "from_domain", *H.HEADER_FEATURES]
    return closed(df, {n: F.col(n) for n in names}, drop=set(df.columns) - set(before))


def with_attachment_features(df: DataFrame, raw_col: str) -> DataFrame:
    df = df.withColumn("_files", attachment_names(F.col(raw_col)))
    return closed(df, H.attachment_summary(F.col("_files")), drop=["_files"])


def mail_features(mails: DataFrame, keep: Iterable[str] = ("mail_id", "label"),
                  attachments: bool = True, matches: bool = False) -> DataFrame:
    """Wide table: ``keep`` plus ``url__*``, ``header__*`` and ``text__*``
    columns, booleans as 0/1. No shuffle: links are handled inside the row.
    ``from_addr`` is kept for the sender check, ``text_matches`` on demand."""
    df = with_url_summary(mails, "body_text")
    df = with_text_features(df, "body_text", matches=matches).drop("body_text")
    df = with_header_features(df, "raw_email_source", "url_domains").drop("url_domains")
    names = list(H.HEADER_FEATURES)
    if attachments:
        df = with_attachment_features(df, "raw_email_source")
        names += H.ATTACHMENT_FEATURES
    df = df.selectExpr(
        *keep, *(["text_matches"] if matches else []), "from_addr", "from_domain",
        *[f"{n} as url__{n}" for n in URL_FEATURES],
        *[f"{n} as header__{n}" for n in names],
        *[f"{n} as text__{n}" for n in X.TEXT_FEATURES],
    )
    return booleans_to_int(df)


def booleans_to_int(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[
        f"cast(`{f.name}` as int) as `{f.name}`" if isinstance(f.dataType, T.BooleanType) else f"`{f.name}`"
        for f in df.schema.fields
    ])


def one_hot_auth(df: DataFrame, vocabulary: Iterable[str] = tuple(lx.AUTH_VOCABULARY)) -> DataFrame:
    """Replace the three result columns by 0/1 columns of a declared vocabulary."""
    names = [f"header__{c}" for c in CATEGORICAL]
    hot = {f"{n}_{v}": (F.col(n) == v).cast("int") for n in names for v in vocabulary}
    return df.withColumns(hot).drop(*names)


def auth_vocabulary(df: DataFrame, declared: Iterable[str] = tuple(lx.AUTH_VOCABULARY), most: int = lx.AUTH_EXTRA) -> list[str]:
    """Declared values plus the ``most`` frequent others in ``df`` at fit time: the
    columns of the model. Values are words that a sender may invent, so their number is
    bounded; a value beyond it has no column, like one that first appears after fitting.
    Counts are combined before they are compared."""
    found = df.select(F.explode(F.array(*[F.col(f"header__{c}") for c in CATEGORICAL])).alias("v"))
    declared = list(declared)
    rest = found.where(~F.col("v").isin(declared)).groupBy("v").agg(F.count("*").alias("n"))
    return declared + sorted(r.v for r in rest.orderBy(F.desc("n"), "v").limit(most).collect())


def header_vocabulary(mails: DataFrame, raw_col: str = "raw_email_source") -> list[str]:
    """The same from raw messages: no other feature is computed, no body is read."""
    heads = mails.select(F.col(raw_col).alias("raw")).withColumn("head", H.header_block(F.col("raw")))
    heads = U.with_stages(heads, [H.read_stage, *H.auth_stages()])
    return auth_vocabulary(heads.select(*[F.col(c).alias(f"header__{c}") for c in CATEGORICAL]))


def align(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly ``columns``, in that order; missing ones are 0, others dropped."""
    present = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in present else F.lit(0).alias(c) for c in columns])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("url__", "header__", "text__"))]
