import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from baitwatch.operators import dataset as D
from baitwatch.operators import features as FE
from baitwatch.operators import learn as L
from baitwatch.operators import report as RP
from baitwatch.operators.registry import verify_handles
from baitwatch.operators.scan import scan_mails
from baitwatch.operators import trees as T
from baitwatch.operators.social import scan_posts
from baitwatch.plans.fixtures import fixture
from baitwatch.plans.queries import QUERIES
from baitwatch.streaming import scans as ST

STAGES = 5  # the full number of stages is only a parameter


@pytest.fixture(scope="module")
def model(spark, small):
    hot = FE.one_hot_auth(FE.mail_features(fixture(spark, small, "mail")))
    columns = FE.feature_columns(hot)
    rows = D.stratified_split(L.training_table(hot, columns))
    fitted = L.fit_mail_model(rows.filter("not is_test"), columns, STAGES)
    return fitted, rows, hot


def test_model_learns_the_labels(model):
    fitted, rows, hot = model
    test_ids = rows.filter("is_test").select("mail_id")
    scored = L.score_mails(fitted, hot, ("mail_id", "label")).join(test_ids, "mail_id").select(
        "label", (F.col("prediction") == "phishing").cast("int").alias("prediction"))
    assert L.evaluate(scored).first()["accuracy"] > 0.8


def test_cross_validation_has_five_folds(model):
    train = model[1].filter("not is_test").drop("is_test")
    scores = L.cross_validate(train, max_iter=2)
    summary = L.cv_summary(scores).first()
    assert summary["folds"] == 5 and 0.7 < summary["mean_accuracy"] <= 1.0


def test_fits_start_from_written_rows(spark, monkeypatch):
    """Every task of a fit carries the plan of its rows: no join or shuffle may be in it."""
    plans, fitting = [], L.boosted_trees

    class Watched:
        def __init__(self, *args):
            self.trees = fitting(*args)

        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString() + rows._jdf.queryExecution().toRdd().toDebugString())
            return self.trees.fit(rows)

    monkeypatch.setattr(L, "boosted_trees", Watched)
    mails = spark.range(60).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).alias("url__a"))
    rows = D.stratified_split(L.training_table(mails, ["url__a"])).filter("not is_test").drop("is_test")
    L.fit_mail_model(rows, ["url__a"], 1)
    assert L.cross_validate(rows, max_iter=1).count() == 5
    assert len(plans) == 6 and not any(word in plan for plan in plans for word in ("Join", "Exchange", "Shuffled"))


def test_saved_model_keeps_columns_and_scores(model, tmp_path):
    fitted, _, hot = model
    L.save_model(fitted, str(tmp_path / "m"))
    loaded = L.load_model(str(tmp_path / "m"))
    assert L.model_columns(loaded) == FE.feature_columns(hot)
    some = hot.drop("url__num_urls")
    cols = ("mail_id", "phishing_probability")
    a, b = (sorted(map(tuple, L.score_mails(m, some).select(*cols).collect())) for m in (fitted, loaded))
    assert a == b and all(0 <= p <= 1 for _, p in a)
    top = L.top_importances(loaded, some.sparkSession, 15).collect()
    assert len(top) == 15 and top[0]["importance"] >= top[-1]["importance"]


def test_trees_as_a_table_score_like_the_model(spark, model, tmp_path):
    fitted, _, hot = model
    nodes = L.model_nodes(fitted)
    T.save_nodes(T.node_table(spark, nodes), str(tmp_path / "nodes"))
    loaded = T.load_nodes(spark, str(tmp_path / "nodes"))
    assert loaded == sorted(nodes)
    ours = T.with_probability(hot.select("mail_id", *L.model_columns(fitted)), loaded, "_p")
    both = fitted.transform(ours).select("_p", vector_to_array("probability")[1].alias("q")).collect()
    assert both and all(abs(r["_p"] - r["q"]) < 1e-9 for r in both)
    # A deep, one-sided tree, a single leaf, NaN and null go right.
    odd = [T.Node(0, 0, 1.0, "a", 1.0, 1, 2, None), T.Node(0, 1, 1.0, None, None, None, None, 2.0), T.Node(0, 2, 1.0, "b", 0.0, 3, 4, None),
           T.Node(0, 3, 1.0, None, None, None, None, 3.0), T.Node(0, 4, 1.0, None, None, None, None, 5.0), T.Node(1, 0, 0.5, None, None, None, None, 8.0)]
    rows = spark.createDataFrame([(1.0, 9.0), (2.0, 0.0), (2.0, 1.0), (float("nan"), 1.0), (None, -1.0)], "a double, b double")
    assert [r[0] for r in rows.select(T.margin(odd)).collect()] == [6.0, 7.0, 9.0, 9.0, 7.0]


def test_filters_reach_the_scan_below_the_scores(spark, small, model):
    mails = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("mail_id"), F.col("text").alias("body_text"), F.col("text").alias("raw_email_source"))
    plan = scan_mails(mails, model[0]).where("mail_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan.split("PushedFilters", 1)[1]


def test_scan_is_one_narrow_plan(spark, small, model):
    mails = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("mail_id"), F.col("text").alias("body_text"), F.col("text").alias("raw_email_source"))
    plan = scan_mails(mails, model[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mail_stream_equals_batch(spark, small, model, tmp_path):
    mails = fixture(spark, small, "mail").select("mail_id", "body_text", "raw_email_source")
    mails.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ST.scan_mail_stream(ST.read_landing(spark, str(tmp_path / "in"), ST.MAIL_INPUT, max_files=1), model[0])
    query = ST.write_stream(ST.as_json(stream, "mail_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    got = {int(r["key"]): json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["key"]: json.loads(r["value"]) for r in ST.as_json(scan_mails(mails, model[0]), "mail_id").collect()}
    assert got == {int(k): v for k, v in batch.items()} and len(got) == mails.count()


def test_mail_rejects_have_a_reason(spark, model, tmp_path):
    spark.createDataFrame([(1, "body", "From: a@b.c\n\nbody"), (2, None, "x"), (3, "b", None)], ST.MAIL_INPUT).write.parquet(str(tmp_path / "in"))
    landed = ST.read_landing(spark, str(tmp_path / "in"), ST.MAIL_INPUT)
    ST.route_mails(landed, model[0], *(str(tmp_path / d) for d in ("ok", "no", "cp"))).awaitTermination(240)
    assert [r["mail_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert {r["mail_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "no")).collect()} == {
        2: "missing_body_text", 3: "missing_raw_email_source"}


def test_post_stream_equals_batch(spark, small, tmp_path):
    posts = fixture(spark, small, "post").select(
        "post_id", "post_text", F.lit("twitter").alias("platform"),
        F.when(F.col("post_id") % 2 == 0, F.lit("@Supplier0")).otherwise(F.col("handle")).alias("handle"),
        *[F.col(f.name).cast(f.dataType) for f in ST.POST_INPUT.fields[4:]])
    posts.repartition(2).write.parquet(str(tmp_path / "in"))
    handles, entities = (fixture(spark, small, n) for n in ("entity_handle", "entity"))
    as_of = F.lit("2024-02-01").cast("date")
    landed = ST.read_landing(spark, str(tmp_path / "in"), ST.POST_INPUT)
    stream = ST.scan_post_stream(landed, handles, entities, as_of)
    ST.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = verify_handles(scan_posts(posts, as_of, ("post_id", "platform", "handle")), handles, entities)
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert got.filter("verified").count() == 0 < got.filter("status = 'revoked'").count()


def test_posts_meet_the_registry_of_their_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    row = ("p", "x", "one")
    posts = spark.createDataFrame([row], "post_text string, platform string, handle string")
    full = posts.select(*[F.col(f.name) if f.name in posts.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ST.POST_INPUT.fields])
    handles = spark.createDataFrame([(1, "x", "one")], "entity_id long, platform string, handle string")
    status = ["active"]

    def registry():
        return handles, spark.createDataFrame([(1, "One", status[0])], "id long, entity_name string, status string")

    for now in ("active", "revoked"):
        status[0] = now
        full.write.mode("append").parquet(path)
        ST.route_posts(ST.read_landing(spark, path, ST.POST_INPUT), registry, F.lit("2024-02-01").cast("date"),
                       str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).select("batch_id", "verified").collect()
    assert sorted(map(tuple, got)) == [(0, True), (1, False)]


def test_uploads_are_routed_once(spark, small, tmp_path):
    fixture(spark, small, "upload").select("path", "kind", "length").repartition(2).write.parquet(str(tmp_path / "in"))
    landed = ST.read_landing(spark, str(tmp_path / "in"), ST.UPLOAD_INPUT, max_files=1)
    for _ in range(2):  # the second start finds nothing new
        ST.route_uploads(landed, *(str(tmp_path / d) for d in ("ok", "no", "cp"))).awaitTermination(240)
    ok, no = (spark.read.parquet(str(tmp_path / d)) for d in ("ok", "no"))
    assert ok.count() + no.count() == fixture(spark, small, "upload").count()
    assert ok.count() > 0 and {r[0] for r in no.select("reason").distinct().collect()} == {"too_large", "unsupported_type"}


def test_repeated_deliveries_are_dropped_within_the_delay(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:05:00"), (1, "2024-01-01 12:00:00"), (1, "2024-01-01 10:00:00"), (None, "2024-01-01 10:00:00")]
    schema = "mail_id long, received_at timestamp"
    got = []
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "mail_id long, t string").select("mail_id", F.to_timestamp("t").alias("received_at")).write.mode("append").parquet(str(tmp_path / "in"))
        landed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ST.write_stream(ST.first_deliveries(landed), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
        got.append(sorted(r["mail_id"] or 0 for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [[1, 2], [0, 1, 2]]


def test_incident_stream_equals_the_report(spark, tmp_path):
    """Channels land in several files and restarts, with a replay of the last start."""
    def verdicts(name, n, step):
        return spark.range(n).select((F.col("id") * step % 40).alias("incident_id"), F.lit(name).alias("risk_tier"),
                                     (F.col("id") / n).alias("score")).dropDuplicates(["incident_id"]).withColumn(
            "seen_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=F.col("incident_id").cast("int")))

    batch = {c: verdicts(c, n, step) for c, n, step in (("mail", 30, 1), ("video", 20, 3), ("social", 25, 7))}
    want = RP.incident_report({c: df.select("incident_id", F.window("seen_at", "1 day")["start"].alias("day"), "risk_tier", "score") for c, df in batch.items()},
                              ("incident_id", "day"))
    for turn in range(3):
        for c, df in batch.items():
            df.where(F.col("incident_id") % 3 == turn).repartition(2).write.mode("append").parquet(str(tmp_path / c))
        streams = {c: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / c)) for c, df in batch.items()}
        ST.route_incidents(ST.incident_stream(streams, delay="3 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    got = ST.latest_incidents(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_fit_rows_lie_evenly(spark):
    """A split by class leaves its rows in a partition a class; a fit has one a core."""
    rows = spark.range(4000).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"))
    held = L.settled(D.stratified_split(rows.coalesce(1)).filter("not is_test").select("mail_id", "label"))
    sizes = [r["n"] for r in held.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3200 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)


def test_wide_rows_of_one_row_group_are_dealt_out(spark, small):
    rows = QUERIES["feature_align"](spark, small).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(rows) > 8 and max(r["n"] for r in rows) < 40
