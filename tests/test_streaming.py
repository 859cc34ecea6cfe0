"""A stream over several files ends where its batch twin does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsmill.operators import collect as K, health as H, lifecycle as Y
from newsmill.plans import fixtures as X
from newsmill.sources.url_memory import UrlMemory
from newsmill.streaming import collection as C, state as S

ONCE = {"availableNow": True}


def streamed(spark, df, folder, files: int = 3):
    """A stream that reads ``df`` file by file, in order of its first column."""
    key = df.columns[0]
    step = df.agg(F.max(key)).first()[0] // files + 1
    for k in range(files):
        df.filter((F.col(key) >= k * step) & (F.col(key) < (k + 1) * step)).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(query):
    assert query.awaitTermination(240)


@pytest.mark.parametrize(("table", "start", "fold", "keys"), [
    (X.checks, S.source_health_stream, H.source_health, ["source_id"]), (X.failures, S.failure_policy_stream, Y.failure_policy, ["article_id", "stage"]),
    (X.stage_events, S.progress_stream, H.cycle_stages, ["cycle_id", "stage"]),
])
def test_states_equal_the_batch_after_a_restart(spark, sf_dir, tmp_path, table, start, fold, keys):
    table(spark, sf_dir).repartition(1).write.parquet(str(tmp_path / "all"))
    events = spark.read.parquet(str(tmp_path / "all")).withColumn("_part", F.pmod(F.xxhash64(*[F.col(k) for k in ("ts", keys[0])]), F.lit(4)))
    read, places = [], [str(tmp_path / p) for p in ("out", "ck")]
    for turn in ((0, 1), (2, 3)):  # the second turn starts from the checkpoint of the first; its rows are not later ones
        for part in turn:
            events.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = start(stream, *places, ONCE)
        run(query)
        read += [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert sorted(read) == sorted(events.groupBy("_part").count().toPandas()["count"].tolist())  # each batch reads its own rows only
    batch = fold(events.drop("_part"))
    found = S.states(spark, places[0], batch.schema, keys)
    rounded = lambda d: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in d.select(*batch.columns).collect())
    assert rounded(found) == rounded(batch)


def test_streamed_collection_is_the_sequential_choice(spark, tmp_path):
    at = X.now() - F.make_dt_interval(hours=F.lit(5))
    title = F.concat(F.lit("A story of the laboratory that is told by number "), F.repeat((F.col("item_id") % 11 * 37 + 100).cast("string"), 3), F.when(F.col("item_id") >= 60, "!?").otherwise("x"))
    items = spark.range(90).select(F.col("id").alias("item_id")).select(
        "item_id", F.lit("src").alias("source"), title.alias("title"), F.concat(F.lit("https://a.example/"), F.col("item_id") % 70).alias("link"), F.lit("text").alias("description"),
        F.when(F.col("item_id") % 10 != 9, at).alias("date"),
    )
    items.write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    run(C.collect_stream(streamed(spark, rows, tmp_path / "in"), str(tmp_path / "memory"), str(tmp_path / "ck"), X.now(), ONCE))
    decided = UrlMemory(spark, str(tmp_path / "memory")).rows()
    batch = K.collect(rows, spark.createDataFrame([], "link string"), X.now())
    inserted = lambda d: {r.item_id for r in d.filter("decision = 'inserted'").collect()}
    assert decided.count() == 90
    assert inserted(decided) == inserted(batch) and len(inserted(batch)) == 11
    # rows of later files meet the titles of earlier ones
    assert decided.filter("decision = 'semantic-title' and match_id < 30 and item_id >= 60").count() > 0


def test_guard_and_first_per_url(spark, sf_dir, tmp_path):
    K.feed_candidates(X.feed_items(spark, sf_dir), X.now()).write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    stream = C.first_per_url(C.time_guard(streamed(spark, rows, tmp_path / "in"), X.now()))
    run(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(**ONCE).start())
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert out.count() == K.time_guard(rows, X.now()).select("link").distinct().count()


def test_memory_equals_the_anti_join(spark, tmp_path):
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("http://a.net/"), F.col("id")).alias("link"))
    memory = UrlMemory(spark, str(tmp_path / "memory"), n_blocks=512)
    assert memory.known(urls(0, 10)).count() == 0 and memory.rows() is None
    assert memory.append(0, urls(0, 5000).withColumn("ok", F.col("link").endswith("7")), F.col("ok"))
    assert not memory.append(0, urls(0, 1).withColumn("ok", F.lit(True)))
    assert memory.append(1, urls(5000, 9000).unionAll(spark.createDataFrame([(None,)], "link string")).withColumn("ok", F.lit(False)), F.lit(None).cast("boolean") | F.col("ok"))
    assert memory.append(2, urls(9000, 15000).withColumn("ok", F.lit(True)))
    asked = urls(0, 30_000).unionAll(urls(0, 100))
    expected = asked.distinct().join(memory.rows().filter("ok").select("link"), "link", "left_semi")
    found = memory.known(asked)
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0 and found.count() == 500 + 6000
    assert memory.false_positive_rate(asked) < 0.01
    assert "BroadcastHashJoin" in memory.possible(asked)._jdf.queryExecution().toString()
