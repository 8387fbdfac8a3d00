"""Sources and sinks on files."""

import json

import pytest
from pyspark.sql import functions as F

from streammart.operators import ingest, tables
from streammart.sources import readers, writers


def test_snapshot_then_changes_give_the_current_table(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    records = [
        {"op": "u", "source": {"db": "mart", "table": "t"}, "before": {"id": "1", "name": "a"}, "after": {"id": "1", "name": "x"}, "ts_ms": 5},
        {"op": "d", "source": {"db": "mart", "table": "t"}, "before": {"id": "2", "name": "b"}, "after": None, "ts_ms": 6},
        {"op": "c", "source": {"db": "mart", "table": "t"}, "before": None, "after": {"id": "4", "name": "d"}, "ts_ms": 7},
    ]
    (tmp_path / "log.txt").write_text("\n".join([*map(json.dumps, records), "{broken"]))
    log = readers.changes(readers.lines(spark, str(tmp_path / "log.txt")))
    assert [tuple(r) for r in log.orderBy("ts").select("type", F.size("data")).collect()] == [("update", 2), ("delete", 0), ("insert", 2)]
    # A delete's image is empty; its key comes with the image before, which the record keeps.
    log = log.withColumn("key", F.when(F.col("type") == "delete", "2").otherwise(F.col("data")["id"]))
    whole = readers.snapshot_then_changes(snapshot, log.drop("key"), "mart", "t")
    keyed = whole.withColumn("key", F.coalesce(F.col("data")["id"], F.lit("2")))
    now = ingest.latest_state(keyed, ["key"], F.desc("ts")).select("key", F.col("data")["name"])
    assert sorted(map(tuple, now.collect())) == [("1", "x"), ("3", "c"), ("4", "d")]


def test_json_rows_and_multi_line_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id int, name string")
    assert sorted(r[0] for r in writers.as_json(rows).collect()) == ['{"id":1}', '{"id":2,"name":"b"}']
    (tmp_path / "p.json").write_text('[\n {"path": ["home"],\n "rate": 20},\n {"path": [], "rate": 5}\n]')
    assert readers.resource(spark, str(tmp_path / "p.json")).agg(F.sum("rate")).first()[0] == 25
    assert [r["id"] for r in readers.records(rows.orderBy("id"))] == [1, 2]
    assert readers.lookup(spark, rows, id=9) is None


def test_facts_go_to_a_folder_each(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([({"id": "1"}, "a"), ({"id": "2"}, "b")], "data map<string,string>, sink_table string").write.parquet(source)
    stream = spark.readStream.schema("data map<string,string>, sink_table string").parquet(source)
    writers.by_sink_table(stream, f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.text(f"{tmp_path}/out/sink_table=a").first()["value"] == '{"id":"1"}'


def test_repeated_batches_replace_themselves(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 00:00:00", 1)], "stt string, v int")
    sink = writers.stats_sink(f"{tmp_path}/stats", ["v"])
    sink(batch, 0)
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/stats").count() == 2


def test_dimension_sink_keeps_the_last_change(spark, tmp_path):
    schema = "sink_table string, sink_columns string, sink_pk string, type string, ts long, data map<string,string>"
    first = [("d", "id,name", "id", "insert", 1, {"id": "1", "name": "a"}), ("d", "id,name", "id", "insert", 1, {"id": "2", "name": "b"})]
    second = [("d", "id,name", "id", "update", 2, {"id": "1", "name": "z"}), ("d", "id,name", "id", "delete", 3, {"id": "2", "name": "b"})]
    sink = writers.dimension_sink(f"{tmp_path}/dims")
    sink(spark.createDataFrame(first, schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame(second, schema), 1)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/dims/d").collect()] == [("1", "z")]
    assert tables.delete_where(spark.range(3), "id = 1").count() == 2


@pytest.mark.parametrize("died", ["before the move", "after the move"])
def test_a_writer_that_dies_in_the_swap_loses_no_row(spark, tmp_path, died):
    schema = "sink_table string, sink_columns string, sink_pk string, type string, ts long, data map<string,string>"
    rows = lambda *some: spark.createDataFrame([("d", "id,name", "id", "insert", 1, {"id": i, "name": n}) for i, n in some], schema)
    sink = writers.dimension_sink(f"{tmp_path}/dims")
    table, before = tmp_path / "dims" / "d", tmp_path / "dims" / ".d-before"
    sink(rows(("1", "a"), ("2", "b")), 0)
    if died == "before the move":
        table.rename(before)
    else:
        sink(rows(("3", "c")), 1)
        spark.createDataFrame([("9", "stale")], "id string, name string").write.parquet(str(before))
    sink(rows(("3", "c")), 1)
    assert sorted(map(tuple, spark.read.parquet(str(table)).collect())) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert not before.exists()


def test_a_failed_move_puts_the_table_back(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    with pytest.raises(Exception):
        writers.replace_folder(spark, f"{tmp_path}/nothing", f"{tmp_path}/t")
    assert writers.read_if_there(spark, f"{tmp_path}/t").count() == 3
    writers.truncate(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0
