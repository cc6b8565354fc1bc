from datetime import datetime, timedelta

from corrobora.streaming.incremental import append_atoms, atom_stream, event_windows
from tests.fixtures import people


def test_new_files_become_atoms_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    people(src)
    go = lambda: append_atoms(atom_stream(spark, str(src)), str(tmp_path / "atoms"), str(tmp_path / "cp")).awaitTermination(120)
    go()
    n = spark.read.parquet(str(tmp_path / "atoms")).count()
    assert n > 40
    (src / "late.csv").write_text("name\nLate Lara\n")
    go()
    go()
    after = spark.read.parquet(str(tmp_path / "atoms"))
    assert after.count() == n + 1 and after.where("value = 'Late Lara'").count() == 1


def test_windows_in_a_stream_equal_the_batch(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(i, t + timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "e"))
    stream = event_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, event_windows(df).collect()))
