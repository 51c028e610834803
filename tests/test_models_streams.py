"""Caller models, dictionaries and streams."""

import re

from pyspark.sql import functions as F

from quillmask import STYLE_ENTITY_TAGS, anonymise
from quillmask.operators.annotations import attach_entities, dictionary_entities
from quillmask.operators.models import attach_model
from quillmask.streaming.streams import detection_counts, write_stream


def toy_model_loader():
    """A loader defined in a function travels to the workers by value."""

    def load():
        def model(texts):
            """Words that follow "by" are people, all other capitalised words products."""
            for text in texts:
                words = list(re.finditer(r"\w+", text))
                tokens = [(w.start(), w.end(), w.group(), "PROPN" if w.group()[0].isupper() else "X") for w in words]
                entities = [
                    (w.start(), w.end(), "PERSON" if before.group() == "by" else "PRODUCT")
                    for before, w in zip(words, words[1:])
                    if w.group()[0].isupper()
                ]
                yield entities, tokens

        return model

    return load


def test_caller_model(spark):
    df = spark.createDataFrame([(0, "sent by Ünal to Acme"), (1, None)], "id int, text string")
    joined = attach_model(df, {"text": ("ents", "toks")}, toy_model_loader())
    result = anonymise(
        joined, columns=["text"], key="id", style=STYLE_ENTITY_TAGS, entities={"text": "ents"}, tokens={"text": "toks"}
    )
    assert sorted(tuple(r) for r in result.data.select("id", "text_Anonymised").collect()) == [
        (0, "sent by <PERSON> to Acme"),
        (1, ""),
    ]
    assert [(r["label"], r["text"]) for r in result.residuals().collect()] == [
        ("POSSIBLE_MISSED_NAME (model tagged PRODUCT)", "Acme")
    ]


def test_dictionary_feeds_the_pipeline(spark):
    df = spark.createDataFrame(
        [(0, "moved to NEW  York, then york."), (1, "no place"), (2, None)], "id int, text string"
    )
    words = spark.createDataFrame([("New York", "GPE"), ("York", "GPE")], "term string, label string")
    found = dictionary_entities(df, "text", "id", words)
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(9, 18), (14, 18), (25, 29)]
    joined = attach_entities(df, found, "id", {"text": "ents"})
    result = anonymise(
        joined, columns=["text"], key="id", entity_types=["LOCATION"], style=STYLE_ENTITY_TAGS, entities={"text": "ents"}
    )
    assert sorted(tuple(r) for r in result.data.select("id", "text_Anonymised").collect()) == [
        (0, "moved to <LOCATION>, then <LOCATION>."),
        (1, "no place"),
        (2, ""),
    ]


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, text string"

    def push(texts):
        rows = [(f"2024-01-01 {h:02d}:00:00", t) for h, t in texts]
        frame = spark.createDataFrame(rows, "ts string, text string")
        frame.select(F.col("ts").cast("timestamp").alias("ts"), "text").coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        write_stream(anonymise(stream).data, out, mark, available_now=True).awaitTermination()
        return sorted(r["text_Anonymised"] for r in spark.read.parquet(out).collect())

    push([(1, "Mr Smith"), (2, "x")])
    assert drain() == ["<REDACTED>", "x"]
    push([(3, "a@b.example.com y")])
    assert drain() == ["<REDACTED>", "<REDACTED> y", "x"]


def test_windowed_counts_leave_open_windows_out(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", "Mr A, Mr B"), ("2024-01-01 00:50:00", "07700900123"), ("2024-01-01 05:00:00", "Mr C")]
    spark.createDataFrame(rows, "ts string, text string").select(
        F.col("ts").cast("timestamp").alias("ts"), "text"
    ).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, text string").parquet(source)
    counts = detection_counts(anonymise(stream, key="ts"), "ts", "1 hour", "1 hour")
    out = str(tmp_path / "out")
    write_stream(counts, out, str(tmp_path / "mark"), available_now=True).awaitTermination()
    got = sorted((r["entity_type"], r["detections"]) for r in spark.read.parquet(out).collect())
    assert got == [("PERSON", 2), ("PHONE_NUMBER", 1)]
