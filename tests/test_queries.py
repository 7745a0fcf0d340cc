"""Every registered query against its DuckDB counterpart, and the fixtures'
guard: each flag must be seen both true and false."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from baitwatch.plans.fixtures import FIXTURES, fixture, fixture_sql

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SLOW = {"model_cv", "model_scores", "model_importances", "mail_scan"}  # run in test_model_and_streams


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return repr(round(float(v), 9)) if isinstance(v, (int, float, decimal.Decimal)) else repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixture_is_the_same_in_both_engines(spark, small, duck, name):
    df = fixture(spark, small, name)
    cur = duck.execute(fixture_sql(name))
    assert table(df.columns, df.collect()) == table([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cur = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_sql_or_is_a_model(small):
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(entry.oracle_sql()) == SLOW
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_flag_occurs_both_ways(spark, small):
    wide = entry.queries()["mail_features_wide"](spark, small)
    flags = [c for c in wide.columns if c.split("__")[0] in ("url", "header", "text")
             and wide.schema[c].dataType.simpleString() == "int"]
    row = wide.agg(*[F.min(F.col(c) > 0).alias(c) for c in flags], *[F.max(F.col(c) > 0).alias(f"max_{c}") for c in flags]).first()
    always_positive = {"text__word_count", "text__sentence_count"}
    for c in flags:
        assert row[f"max_{c}"], f"{c} never fires"
        assert not row[c] or c in always_positive, f"{c} always fires"


def test_every_account_flag_occurs_both_ways(spark, small):
    flags = {"beh_age": ["very_new_account"], "beh_flags": ["abnormal_posting_frequency", "suspicious_follow_ratio",
             "suspicious_handle_pattern"], "beh_redflags": ["likely_coordinated_or_bot"]}
    for name, columns in flags.items():
        for c in columns:
            assert entry.queries()[name](spark, small).select(c).distinct().count() == 2, c
