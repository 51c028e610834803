"""Outputs are seen whole or not at all, from batches and from streams."""

import os

import pytest
from pyspark.sql import functions as F

from quillmask import STYLE_ENTITY_TAGS, anonymise
from quillmask.sources import writers
from quillmask.sources.writers import DATA, DETECTIONS, RESIDUALS, STATS, read_outputs, write_outputs
from quillmask.streaming.streams import read_stream_outputs, write_stream_outputs


def seen(found, output=DATA):
    return sorted(map(tuple, found[output].collect()), key=str)


def test_a_failed_run_leaves_the_last_one_readable(spark, run, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_outputs(spark, out)
    write_outputs(run(["ring 07700 900123"]), out)
    before = seen(read_outputs(spark, out))
    save, calls = writers._save, []

    def failing(df, path, file_format):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("disk full")
        save(df, path, file_format)

    later = run(["Mr Smith, 98765432", "x"])
    monkeypatch.setattr(writers, "_save", failing)
    with pytest.raises(OSError):
        write_outputs(later, out)
    assert seen(read_outputs(spark, out)) == before
    assert not os.path.exists(os.path.dirname(calls[0]))
    monkeypatch.setattr(writers, "_save", save)
    write_outputs(later, out)
    found = read_outputs(spark, out)
    assert [r[2] for r in seen(found)] == ["<REDACTED>, 98765432", "x"]
    assert seen(found, STATS) == sorted(map(tuple, later.stats().collect()))
    assert found[STATS].columns == later.stats().columns


def test_runs_are_published_once(spark, tmp_path):
    out = str(tmp_path / "out")
    writers.publish(spark, out, 0, {DATA: "a"})
    with pytest.raises(FileExistsError):
        writers.publish(spark, out, 0, {DATA: "b"})
    assert writers.numbers(spark, out) == [0] and writers.paths_of(spark, out, 0) == [{DATA: "a"}]


def test_stream_outputs_equal_the_batch_and_survive_a_stop(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    texts = ["Mr Smith 98765432", "plain", None, "a@b.example.com", "Sent by Jo Bloggs", "SW1A 1AA", "x", "07700 900123"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df.repartition(4).write.parquet(source)
    settings = {"key": "id", "style": STYLE_ENTITY_TAGS}

    def drain():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        write_stream_outputs(stream, out, mark, available_now=True, **settings).awaitTermination()

    save, calls = writers._save, []

    def failing(frame, path, file_format):
        calls.append(path)
        if len(calls) == 6:
            raise OSError("stopped")
        save(frame, path, file_format)

    monkeypatch.setattr(writers, "_save", failing)
    with pytest.raises(Exception, match="stopped"):
        drain()
    monkeypatch.setattr(writers, "_save", save)
    assert 1 <= read_stream_outputs(spark, out)[DATA].count() < len(texts)
    drain()
    drain()
    found, batch = read_stream_outputs(spark, out), anonymise(df, **settings)
    assert seen(found) == sorted(map(tuple, batch.data.collect()), key=str)
    assert seen(found, DETECTIONS) == sorted(map(tuple, batch.detections().collect()), key=str)
    assert seen(found, RESIDUALS) == sorted(map(tuple, batch.residuals().collect()), key=str)
    sums = found[STATS].agg(*[F.sum(c) for c in ("records_processed", "pii_entities_detected", "total_cells")]).first()
    assert tuple(sums) == tuple(batch.stats().select("records_processed", "pii_entities_detected", "total_cells").first())
