import gzip
import json

import pytest
from pyspark.sql import functions as F

from glossmill.operators import dataset
from glossmill.plans import inputs
from glossmill.sources import readers, writers


def test_gzip_lines_with_text_or_number_positions(spark, tmp_path):
    path = tmp_path / "f.json.gz"
    with gzip.open(path, "wt") as f:
        f.write(json.dumps({"id": "a", "paths": ["o/n/x.ts"], "line": "3", "character": "4", "comments": "c", "text": "t"}) + "\n")
        f.write(json.dumps({"id": "b", "paths": [], "line": 5, "character": 0, "comments": "é", "text": "u", "stars": 7}) + "\n")
    df = readers.read_functions_jsonl(spark, str(path), partitions=4)
    assert dict(df.dtypes)["line"] == "int" and df.rdd.getNumPartitions() == 4
    assert {(r.id, r.line, r.character, r.stars) for r in df.collect()} == {("a", 3, 4, None), ("b", 5, 0, 7)}


def test_crlf_lines_replace_earlier_output(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, 2, "c", "line\nbreak \r\n", "t")], readers.ENTRY_SCHEMA)
    for _ in range(2):
        writers.write_entries_jsonl(rows, path)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert raw.endswith(b"\r\n") and raw.count(b"\r\n") == 1
    assert readers.read_entries_jsonl(spark, path).collect() == rows.collect()


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [('a, "b"', " x\ny ", "\\z"), ("t", '"', "q\\")], "ast string, comments string, comments_orig string"
    )
    writers.write_clean_csv(rows.withColumn("extra", F.lit(1)), str(tmp_path / "csv"))
    assert sorted(readers.read_clean_csv(spark, str(tmp_path / "csv")).collect()) == sorted(rows.collect())


def test_metadata_and_vocabulary(spark, sf_dir, tmp_path):
    profile = dataset.dataset_profile(inputs.length_mix(spark, sf_dir))
    writers.write_metadata(profile, str(tmp_path / "meta"))
    stored = readers.read_metadata(spark, str(tmp_path / "meta")).first()
    assert stored.observations == profile.first().observations
    assert stored.avg_comment_len == pytest.approx(profile.first().avg_comment_len, abs=0.005)
    vocab = spark.createDataFrame([("UNK", 1), ("a", 2)], "token string, id int")
    writers.write_vocabulary(vocab, {"max_comment_len": 200}, str(tmp_path / "v"))
    tokens, params = readers.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(tokens.collect()) == sorted(vocab.collect())
    assert [tuple(r) for r in params.collect()] == [("max_comment_len", 200)]


def test_shards_and_spread(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"month.20{i}"))
    spark.range(9, 10).write.parquet(str(tmp_path / "year.2020"))
    shards = readers.read_shards(spark, str(tmp_path / "month.20*"))
    assert sorted(r.id for r in shards.collect()) == [0, 1, 2]
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(shards.coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=cores + 1)
    assert readers.spread(wide) is wide


def test_clean_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """One task's rows go to several files, since a file with texts over lines is read by one task."""
    monkeypatch.setattr(writers, "FILE_ROWS", 10)
    rows = [(f"a{i}", f'x "{i}"\n, y', f"{i}\n") for i in range(35)]
    clean = spark.createDataFrame(rows, "ast string, comments string, comments_orig string").coalesce(1)
    writers.write_clean_csv(clean, f"{tmp_path}/clean")
    assert len(list((tmp_path / "clean").glob("*.csv"))) == 4
    assert sorted(map(tuple, readers.read_clean_csv(spark, f"{tmp_path}/clean").collect())) == sorted(rows)
