"""Readers and writers over small files."""

import hashlib
import json

import pyarrow as pa
import pytest

from tessera.sources import readers, sinks


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_lines_skip_blanks_and_refuse_damage(spark, tmp_path):
    good = _write(tmp_path / "a.jsonl", '{"id": 1, "t": "x"}\n\n   \n{"id": 2, "t": null}\n')
    assert [tuple(r) for r in readers.json_lines(spark, good).orderBy("id").collect()] == [(1, "x"), (2, None)]
    bad = _write(tmp_path / "b.jsonl", '{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, bad, "id long").collect()


def test_json_rows_of_arrays_and_data(spark, tmp_path):
    one = _write(tmp_path / "a.json", '[{"id": 1}, {"id": 2}]')
    two = _write(tmp_path / "b.json", '{"data": [{"id": 3}, {"id": 4}]}')
    assert sorted(r.id for r in readers.json_rows(spark, one).collect()) == [1, 2]
    assert sorted(r.id for r in readers.json_rows(spark, two).collect()) == [3, 4]


def test_arrow_shards_and_splits(spark, tmp_path):
    def shard(name, ids, new):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        table = pa.table({"id": ids, "tags": [[str(i)] for i in ids]})
        with new(str(path), table.schema) as out:
            out.write_table(table)

    shard("set/train-0.arrow", [1, 2], pa.ipc.new_file)
    shard("set/train-1.arrow", [3], pa.ipc.new_stream)
    shard("set/test/part.arrow", [9], pa.ipc.new_file)
    base = str(tmp_path / "set")
    assert sorted(r.id for r in readers.arrow_shards(spark, base, "train").collect()) == [1, 2, 3]
    assert [(r.id, r.tags) for r in readers.arrow_shards(spark, base, "test").collect()] == [(9, ["9"])]
    assert readers.arrow_shards(spark, base).count() == 4
    with pytest.raises(FileNotFoundError):
        readers.arrow_shards(spark, base, "dev")
    with pytest.raises(ValueError, match="ambiguous"):
        readers.split_of("x/train_test.arrow")
    assert readers.split_of("x/contest.arrow") is None


def test_described_datasets(spark, tmp_path):
    _write(tmp_path / "a.jsonl", '{"id": 1, "t": "x"}\n')
    _write(tmp_path / "b.json", '[{"id": 2, "u": 0.5}]')
    spec = [{"dataset": "a", "path": "a.jsonl", "format": "jsonl", "role": "train"}, {"dataset": "b", "path": "b.json", "format": "json", "role": "eval"}]
    path = _write(tmp_path / "sets.jsonl", "\n".join(map(json.dumps, spec)))
    got = {r.id: (r.dataset, r.role, r.t, r.u) for r in readers.described(spark, path).collect()}
    assert got == {1: ("a", "train", "x", None), 2: ("b", "eval", None, 0.5)}
    with pytest.raises(ValueError, match="unknown format"):
        readers.described(spark, _write(tmp_path / "c.jsonl", '{"dataset": "a", "path": "a", "format": "csv", "role": "train"}'))


def test_run_logs(spark, tmp_path):
    _write(tmp_path / "logs/a.jsonl", '{"n": 1}\n\n{"n": 2}\n{"n": \n{"n": 4}\n')
    _write(tmp_path / "logs/b.jsonl", '{"n": 5}\n{"n": 6}\n')
    got = sorted(json.loads(r.line)["n"] for r in readers.run_log(spark, str(tmp_path / "logs")).collect())
    assert got == [1, 2, 5, 6]
    with pytest.raises(ValueError, match="damaged"):
        readers.strict_run_log(spark, str(tmp_path / "logs"))
    torn = _write(tmp_path / "torn.jsonl", '{"n": 1}\n{"n": 2}\n{"n"\n\n')
    assert sorted(json.loads(r.line)["n"] for r in readers.strict_run_log(spark, torn).collect()) == [1, 2]
    array = _write(tmp_path / "array.jsonl", '{"n": 1}\n[2]\n{"n": 3}\n')
    assert readers.run_log(spark, array).count() == 1
    long = _write(tmp_path / "long.jsonl", "".join(f'{{"n": {i}}}\n' for i in range(5000)) + "torn")
    rows = readers.strict_run_log(spark, long).orderBy("at").collect()
    assert [json.loads(r.line)["n"] for r in rows] == list(range(5000))


def test_text_chunks(spark):
    texts = ["\n".join(f"line {i}" for i in range(100)), "short", None, "x" * 41, " " * 50]
    got = {(r.id, r.chunk): r.chunk_text for r in readers.text_chunks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    lines = texts[0].split("\n")
    assert got == {(0, 0): "\n".join(lines[:40]), (0, 1): "\n".join(lines[40:80]), (0, 2): "\n".join(lines[80:]), (3, 0): texts[3]}


def test_clean_sets_fail_closed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, source string, text string")
    hits = spark.createDataFrame([(2, "exact"), (2, "ngram"), (2, "exact")], "id long, method string")
    report = {r.source: (r.rows, r.flagged) for r in sinks.clean_sets(rows, hits, "id", "source", str(tmp_path / "out")).collect()}
    assert report == {"a": (2, 1), "b": (1, 0)}
    assert sorted((r.id, r.source) for r in spark.read.json(str(tmp_path / "out/clean")).collect()) == [(1, "a"), (3, "b")]
    assert [(r.id, r.methods) for r in spark.read.json(str(tmp_path / "out/flagged")).collect()] == [(2, ["exact", "ngram"])]
    sinks.clean_sets(rows, hits, "id", "source", str(tmp_path / "part"), complete=False)
    assert not (tmp_path / "part/clean").exists() and (tmp_path / "part/report").exists()


def test_sorted_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(3, None), (1, "x"), (2, "é")], "b long, a string")
    got = sinks.sorted_json_lines(rows, str(tmp_path / "out"), "b").orderBy("file").collect()
    raw = b"".join((tmp_path / "out" / r.file).read_bytes() for r in got)
    assert raw.decode() == '{"a":"x","b":1}\n{"a":"é","b":2}\n{"a":null,"b":3}\n'
    assert all(hashlib.sha256((tmp_path / "out" / r.file).read_bytes()).hexdigest() == r.sha256 for r in got)
    assert [tuple(r) for r in sinks.numbers(spark, {"n": (3, "count"), "k": (None, "not run")}).collect()] == [("k", None, "not run"), ("n", 3.0, "count")]
