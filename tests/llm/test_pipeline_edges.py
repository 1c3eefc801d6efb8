"""The whole pipeline on tables that are empty, wholly rejected, or full of nulls, repeats and extra columns."""

import os
import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k string, piece int"
PACKED = {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def folder(spark, sf, path, rows):
    """A data folder with these documents (and columns whose names clash with inner ones) beside the usual other tables."""
    spark.createDataFrame([(i, t, lang, src, None, "r", None, 3) for i, t, lang, src in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", f"{path}/{name}.parquet")
    return str(path)


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, sf, tmp_path, []))
    assert PACKED <= set(out.columns) and out.count() == 0


def test_pipeline_that_rejects_everything(spark, sf, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "b"), (4, "too short", "en", "a"), (5, "round and " * 200, "en", "a")]
    out = corpus_pipeline.run(spark, folder(spark, sf, tmp_path, rows))
    assert PACKED <= set(out.columns) and out.count() == 0


def test_pipeline_of_null_keys_repeats_and_copies(spark, sf, tmp_path):
    """One row of each class stays, whatever its key; a null key is a key like others."""
    near = text(3).rsplit(" ", 1)[0] + " changed"
    rows = [(None, text(1), None, None), (None, text(1), None, None), (None, text(2), "en", "a"), (7, text(3), "en", "b"), (7, near, "en", "b"), (8, near, "en", None), (9, text(4, 20_000), "en", "c")]
    found = corpus_pipeline.run(spark, folder(spark, sf, tmp_path, rows))
    assert found.schema["piece"].dataType.simpleString() == "int"
    out = found.toPandas()
    first = out[out.start == 0]
    assert sorted(first.doc_id.fillna(-1).astype(int)) == [-1, -1, 7, 9]
    assert out[out.doc_id == 9].length.sum() > 20_000 and out.groupby("sequence_id").length.sum().max() <= 2048
    at = out.sort_values(["sequence_id", "offset"])
    assert ((at.groupby("sequence_id").length.cumsum() - at.length) == at.offset).all()
