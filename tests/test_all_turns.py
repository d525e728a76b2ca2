"""A stream of messages keeps the turns without a request id."""

from datetime import datetime, timedelta

from checks import normalized
from conftest import data_folder

import __spark_entry__ as entry
from lectern.operators import dedup
from lectern.streaming import turns as streams

UID = "6f9619ff-8b86-4d01-b42d-00c04fc964ff"


def test_stream_and_batch_have_the_same_turns(spark, tmp_path):
    t = datetime(2024, 1, 1)
    first = [("3", "s", UID, "user", t + timedelta(minutes=1)), ("2", "s", None, "user", t), ("2", "s", None, "user", t)]
    second = [("1", "s", UID, "user", t), ("4", "s", None, "user", t), ("5", "s", UID, "assistant", t), ("6", None, None, None, t)]
    schema = "id string, session_id string, request_id string, role string, created_at timestamp"
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(first + second, schema)
    messages = streams.read_stream(spark, str(tmp_path / "in"), whole.schema)
    for _ in range(2):  # a second run finds nothing new
        streams.run_unique_turns(messages, str(tmp_path / "out"))
        got = streams.read_unique_turns(spark, str(tmp_path / "out"), whole.schema).toPandas()
        assert normalized(got) == normalized(dedup.dedup_turns(whole).toPandas())
    assert sorted(got["id"]) == ["1", "2", "2", "4", "5", "6"]


def test_no_row_without_request_is_lost(spark):
    got = entry.queries()["s1_all_turns"](spark, data_folder("sf0.001"))
    assert got.filter("request_id IS NULL").count() > 0
