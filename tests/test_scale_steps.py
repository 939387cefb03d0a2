"""Steps whose cost must not grow faster than the tables: stream state, landed
files, large upserts, alerts, upload parsing, the orders build."""

from __future__ import annotations

import datetime as dt
import os
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens import session
from shoplens.operators import upsert as U
from shoplens.plans import queries_streams as QS
from shoplens.sources import tables
from shoplens.sources import upload_files as UF
from shoplens.sources.keyed_table import KeyedTable
from shoplens.streaming import jobs
from tests.conftest import SF_SMALL


def test_state_partitions_are_bounded(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(jobs, "MAX_STATE_PARTITIONS", 2, raising=False)
    made = []
    monkeypatch.setattr(jobs, "_dir", lambda s, kind, name: made.append(os.path.join(tmp_dir, kind, f"{name}-{len(made)}")) or made[-1])
    day = dt.datetime(2026, 1, 1)
    rows = [(k, day + dt.timedelta(hours=k), k % 3, "purchase", 2.0) for k in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(
        os.path.join(tmp_dir, "events.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = jobs.window_states(spark, tmp_dir)
    assert sorted((r["window_start"][:10], r["events"]) for r in got.collect()) == [("2026-01-01", 24), ("2026-01-02", 24), ("2026-01-03", 12)]
    assert jobs.dedup_stream(spark, tmp_dir, ["user_id"], "ts", "10 days", "events").count() == 3
    states = [os.path.join(d, "state", "0") for d in made if "ckpt" in d]
    assert [len([p for p in os.listdir(s) if p.isdigit()]) for s in states] == [2, 2]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_deliveries_land_in_files_of_a_size(spark, tmp_dir):
    path = os.path.join(tmp_dir, "landing")
    QS._land(spark.range(200).select(F.concat(F.lit("a\r\n"), F.col("id").cast("string")).alias("body")).repartition(40), path)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) <= 2
    assert sorted(r[0] for r in spark.read.text(path).collect()) == sorted(f"a {k}" for k in range(200))


def test_large_batches_meet_the_table_in_one_pass(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(U, "MAX_BROADCAST_KEYS", 0)
    table = KeyedTable(spark, os.path.join(tmp_dir, "t"), ["k"], ["at"], buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    table.upsert(frame([("a", 5, "a5"), ("b", 5, "b5"), ("c", 5, "c5"), ("d", None, "d-"), ("", 1, "x")]), 0)
    monkeypatch.setattr(U, "upsert", lambda *a, **k: pytest.fail("stored rows joined"))
    batch = frame([("a", 4, "a4"), ("b", 5, "b5new"), ("c", 6, "c6"), ("c", 7, "c7"), ("d", 1, "d1"), ("e", None, "e-"), (None, 1, "x")])
    for _ in range(2):
        table.upsert(batch, 1)
        assert sorted(r["v"] for r in table.read().collect()) == ["a5", "b5new", "c7", "d1", "e-"]


def test_alert_batches_are_read_once(spark, tmp_dir):
    rows = [(f"2026-01-0{k % 3 + 1} 10:00:00", k, "refunded" if k % 4 == 0 else "paid") for k in range(30)]
    path = os.path.join(tmp_dir, "in")
    spark.createDataFrame(rows, "at string, gmv int, status string").coalesce(1).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def parse(at):
        read.add(1)
        return dt.datetime.fromisoformat(at)

    stream = spark.readStream.schema("at string, gmv int, status string").parquet(path).select(
        F.udf(parse, T.TimestampType()).asNondeterministic()("at").alias("paid_at"), F.col("gmv").cast("decimal(14,2)").alias("gmv"), "status")
    got = jobs.order_alert_stream(spark, stream, out_dir=os.path.join(tmp_dir, "out"))
    assert sorted((r["day"], r["orders"], r["refunds"], r["gmv"]) for r in got.collect()) == [
        (f"2026-01-0{d + 1}", 10, len([k for k in range(30) if k % 3 == d and k % 4 == 0]),
         float(sum(k for k in range(30) if k % 3 == d and k % 4))) for d in range(3)]
    assert read.value == len(rows)


def test_csv_text_is_never_held_whole():
    content = ('中文,"x\r\ny",1\r\n' * 200_000).encode("gbk")
    tracemalloc.start()
    encoding = UF.encoding_of(content, ["utf-8-sig", "utf-8", "gbk"])
    n = sum(1 for _ in UF.csv_rows(content, encoding))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (encoding, n) == ("gbk", 200_000) and peak < len(content) / 2


def test_orders_are_clustered_before_texts_are_derived(spark):
    by_month = tables.std_orders(spark, SF_SMALL, by_month=True)
    plan = by_month._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RebalancePartitions"):]
    assert "SKU" in plan and "SKU" not in below
    plain = tables.std_orders(spark, SF_SMALL)
    assert by_month.columns == [*plain.columns, "paid_month"]
    assert by_month.drop("paid_month").exceptAll(plain).isEmpty() and plain.exceptAll(by_month.drop("paid_month")).isEmpty()
    assert by_month.where("paid_month <> coalesce(date_format(paid_at, 'yyyy-MM'), 'none')").isEmpty()



def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_pages_land_compressed_in_files_of_a_size(spark, tmp_dir, monkeypatch):
    bodies = spark.range(3000).select(F.concat(F.lit('{"orders":[\r\n{"id":"'), F.col("id").cast("string"), F.lit('","status":"PAID"}]}')).alias("body"))
    monkeypatch.setattr(tables, "RECORDS_PER_FILE", 1000)
    path = os.path.join(tmp_dir, "pages")
    tables.land_pages(bodies.coalesce(1), path)
    wanted = {f'{{"orders":[ {{"id":"{i}","status":"PAID"}}]}}' for i in range(3000)}
    assert {r.value for r in spark.read.text(path).collect()} == wanted
    assert _size(path) < sum(map(len, wanted)) / 4
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 3


def test_writes_leave_no_shuffle_files(spark, tmp_dir):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.name() for f in (b for b in _listed(blocks.getAllBlocks())) if f.name().startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get(name)
    with session.shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
        spark.range(1000).repartition(7, "id").write.parquet(os.path.join(tmp_dir, "t"))
    assert not shuffles() - before and spark.conf.get(name) == setting
    assert spark.read.parquet(os.path.join(tmp_dir, "t")).count() == 1000


def _listed(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_keyed_table_keeps_no_staged_batches(spark, tmp_dir, monkeypatch):
    staged = []
    monkeypatch.setattr(U, "staging_path", lambda s, n: staged.append(os.path.join(tmp_dir, f"{n}-{len(staged)}")) or staged[-1])
    t = KeyedTable(spark, os.path.join(tmp_dir, "kt"), ["k"], ["v"], buckets=2)
    for batch in (0, 1):
        t.upsert(spark.createDataFrame([(str(i), i + batch) for i in range(6)], "k string, v int"), batch)
    assert sorted(r.v for r in t.read().collect()) == [1, 2, 3, 4, 5, 6]
    assert len(staged) == 2 and not any(os.path.exists(p) for p in staged)


def test_upsert_of_many_keys_equals_that_of_few_in_one_shuffle_of_both(spark, monkeypatch):
    stored = [("a", 1, "s"), ("a", 9, "t"), ("b", 5, "s"), ("c", 2, "s"), ("d", None, "s"), (None, 1, "s"), (None, 1, "s"), ("", 3, "s"), ("e", 4, "s")]
    batch = [("a", 5, "n"), ("b", 5, "n"), ("c", 1, "n"), ("d", 0, "n"), ("e", None, "n"), ("f", 1, "n"), ("f", 2, "n"), (None, 7, "n"), ("", 8, "n")]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, w string")
    made = lambda: U.upsert(frame(stored), frame(batch), ["k"], [F.col("v")])
    few = sorted(map(repr, made().collect()))
    monkeypatch.setattr(U, "MAX_BROADCAST_KEYS", 0)
    many = made()
    assert sorted(map(repr, many.collect())) == few
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_cleaned_rows_are_written_as_parquet(spark, monkeypatch):
    from shoplens.sources import uploads
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *a, **k: 1 / 0)
    df = spark.createDataFrame([("x", "", "1"), ("x", None, "1"), (None, "", None), ("y", None, "2")], "` a b,(c) ` string, empty string, `订单数` string")
    out = uploads.clean(df)
    assert out.columns == ["a b,(c)", "订单数"] and sorted(map(tuple, out.collect())) == [("x", "1"), ("y", "2")]


def test_pages_of_many_records_are_grouped_before_they_are_json(spark, monkeypatch):
    import json
    import types

    from shoplens.plans import queries_intake as QI
    orders = spark.range(300).selectExpr(
        "concat(id div 3, '-', id % 3) AS order_id", "IF(id div 3 % 4 = 0, 'douyin', 'tiktok') AS platform", "'p' AS product_id", "'n\\n' AS product_name", "'s' AS sku_id",
        "CAST(id AS decimal(14,2)) AS gmv", "CAST(id % 7 AS int) AS quantity", "'USD' AS currency", "IF(id % 2 = 0, 'X', NULL) AS province", "'ASIA' AS site_code",
        "id % 5 = 0 AS is_sample_order", "'paid' AS status", "TIMESTAMP '2020-01-01' AS paid_at", "TIMESTAMP '2020-01-01' AS update_time", "TIMESTAMP '2020-01-01' AS rts_time",
        "CAST(NULL AS timestamp) AS delivery_time", "'c' AS customer_id", "CAST(NULL AS string) AS creator_id", "true AS is_cod", "'dhl' AS shipping_provider")
    pages = spark.createDataFrame([("<html>\n</html>",)], "html string")
    m = types.SimpleNamespace(spark=spark, sf_dir="/none", orders=orders, raw=lambda name: pages)
    plans, land_pages = [], tables.land_pages
    monkeypatch.setattr(QI, "land_pages", lambda bodies, path, **k: plans.append(bodies._jdf.queryExecution().optimizedPlan().toString()) or land_pages(bodies, path, **k))
    monkeypatch.setattr(QI, "land", lambda s, d, n, write, sources: write(p := U.staging_path(s, "paged")) or p)
    bodies = [r.body for r in QI.paged_orders(m).collect()]
    plan = plans[0]
    assert "get_json_object" not in plan.lower() and plan.index(" AS record#") < plan.index("RepartitionByExpression [page")
    got = {}
    for b in bodies:
        if b.startswith('{"orders":[{') and b.endswith("]}"):
            ids = [r["id"] for r in json.loads(b)["orders"]]
            assert len({int(i.split("-")[0]) // QI.ORDERS_PER_PAGE for i in ids}) == 1
            got |= dict.fromkeys(ids)
    assert set(got) == {r.order_id for r in orders.where("platform = 'tiktok'").collect()} and "<html> </html>" in bodies and '{"orders": []}' in bodies
