import __spark_entry__ as entry
from rolefit.plans import scoring
from rolefit.sources.adapters import Views
from rolefit.streaming import sessions as ST

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_stream_scores_equal_batch_scores(spark):
    queries = entry.queries()
    assert rows(queries["k1_stream_score"](spark, FOLDER)) == rows(queries["d5_score_total"](spark, FOLDER))


def one_batch_per_day(spark, tmp_path, days):
    """Events of session 1 on the given days and of session 2 every day, one file a day."""
    folder = tmp_path / "events"
    for day in range(max(days) + 4):
        rows = [(day * 10, day, 2, "uploaded")] + ([(day * 10 + 1, day, 1, "analyzed")] if day in days else [])
        df = spark.createDataFrame(rows, "event_id long, day int, session_id long, status string").selectExpr(
            "event_id", "session_id", "status", "timestamp'2024-01-01 00:00:00' + make_dt_interval(day) AS ts")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream, spark.read.parquet(str(folder))


def test_an_expired_session_does_not_start_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream, events = one_batch_per_day(spark, tmp_path, (0, 7))
    got = ST.run_to_end(ST.stream_expiry(stream), "expiry-test").collect()
    want = {r.session_id: r.created for r in ST.session_expiry(events).collect()}
    assert sorted((r.session_id, r.created) for r in got) == sorted(want.items())


def test_status_over_several_batches(spark, tmp_path):
    stream, events = one_batch_per_day(spark, tmp_path, (0, 2, 3))
    assert rows(ST.run_status(stream)) == rows(ST.session_status(events))


def test_a_session_that_comes_back_after_days_is_still_known(spark, tmp_path):
    stream, events = one_batch_per_day(spark, tmp_path, (0, 2, 6))
    got = rows(ST.run_once_only(stream))
    assert got == rows(ST.once_only(events)) and len(got) == 1


def test_done_sessions_are_kept_between_runs(spark, tmp_path):
    stream, events = one_batch_per_day(spark, tmp_path, (1, 3))
    first = rows(ST.run_once_only(stream, str(tmp_path / "done")))
    assert rows(ST.run_once_only(stream, str(tmp_path / "done"))) == first == rows(ST.once_only(events))


def test_scores_of_two_files_equal_the_batch(spark, tmp_path):
    views = Views(spark, FOLDER)
    folder = str(tmp_path / "documents")
    for part in (0, 1):
        views.documents.filter(f"doc_id % 2 = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(views.documents.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "scores")
    ST.stream_score(stream, lambda batch: scoring.scores_of(views, batch), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    assert rows(got.drop("batch")) == rows(scoring.scores_before(views))


def test_a_batch_groups_no_history_but_its_own(spark):
    views = Views(spark, FOLDER)
    plan = scoring.scores_of(views, views.documents.limit(2))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [row_number" in line]
    assert windows
    for i in windows:  # between the numbering of a history and the orders lies the join with the batch
        below = plan[i:next(k for k in range(i, len(plan)) if "o_orderkey" in plan[k] and "Relation" in plan[k])]
        assert any("LeftSemi" in line for line in below)


def test_a_stream_reads_tables_of_one_file_and_of_many(spark, tmp_path):
    one = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    one.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one.coalesce(1).write.parquet(str(tmp_path / "aside"))
    next((tmp_path / "aside").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    views = Views(spark, str(tmp_path))
    for name in ("documents", "events"):
        assert rows(ST.run_to_end(views.stream(name), f"stream-{name}")) == rows(one)


def test_sessions_that_share_a_group_expire_each_for_itself(spark, tmp_path):
    """Fifty sessions in two groups, two batches, events without a time and without a session."""
    folder, days = str(tmp_path / "events"), {0: range(50), 1: range(0, 50, 2), 9: [99]}
    for day, sessions in days.items():
        found = [(s, day * 24 + s % 7) for s in sessions] + [(s, None) for s in (3, 60)] + [(None, day * 24)]
        df = spark.createDataFrame(found, "session_id long, hour int").selectExpr(
            "session_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, hour) AS ts")
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.session_id: r.created for r in ST.run_to_end(ST.stream_expiry(stream, groups=2), "expiry-groups").collect()}
    want = {r.session_id: r.created for r in ST.session_expiry(spark.read.parquet(folder)).collect() if r.session_id not in (60, 99)}
    assert got == want and len(got) == 51
