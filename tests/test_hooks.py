import json

import pytest
from pyspark.sql import functions as F

from colophon import streaming
from colophon.operators import hooks, vectors
from colophon.operators.chunks import chunk_text


def test_pauses_double_up_to_a_bound():
    assert [hooks.pause(n) for n in (1, 2, 3, 4, 5, 9)] == [1, 2, 4, 8, 10, 10]


def test_attempts_and_fallback():
    waited, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("down")
        return " kept ", 7

    assert hooks.attempted(flaky, "x", 3, waited.append) == ("kept", 7, None) and waited == [1, 2]
    assert hooks.attempted(lambda t: ("  ", 1), "x", 2, waited.append) == ("x", 0, "blank result")


def test_filter_and_totals(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, " "), (4, "bad"), (5, "same")], "k long, t string")

    def call(text):
        if text == "bad":
            raise ValueError("no")
        return text.split()[0], 5

    out = hooks.filtered_context(df, "k", "t", call, attempts=1)
    assert {r["k"]: (r["filtered"], r["fault"]) for r in out.collect()} == {1: ("one", None), 2: ("", None), 3: ("", None), 4: ("bad", "ValueError: no"), 5: ("same", None)}
    assert tuple(hooks.filter_totals(out, df, "k", "t").collect()[0]) == (5, 10, 2, 1)
    assert {r["filtered"] for r in hooks.filtered_context(df, "k", "t").collect()} == {"one two", "", "bad", "same"}


def test_embedding_is_the_mean_over_chunks(spark):
    df = spark.createDataFrame([(1, "a b. c d e. f"), (2, None), (3, "bad")], "k long, t string")

    def load():
        def model(chunks):
            if chunks == ["bad"]:
                raise RuntimeError("x")
            return [[float(len(c)), 1.0] for c in chunks]

        return model

    out = {r["k"]: (r["vector"], r["fault"]) for r in hooks.embedded(df, "k", "t", load, most=3).collect()}
    lengths = [len(c) for c in chunk_text("a b. c d e. f", 3)]
    assert out[1] == ([sum(lengths) / len(lengths), 1.0], None) and out[2] == (None, None) and out[3] == (None, "RuntimeError: x")
    assert hooks.pooled([[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]) == [3.0, 4.0]
    assert hooks.pooled([[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]], "mean") == [8.0, 10.0]
    with pytest.raises(ValueError):
        hooks.pooled([[1.0]], [[1.0]], "max")


def test_whitening_is_read_from_json(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"kernel": [[1, 0], [0, 2]], "bias": [[0.5, 0]]}))
    found = vectors.Whitening.read(spark, str(tmp_path / "w.json"))
    df = spark.createDataFrame([(1, [0.5, 1.0])], "k long, v array<double>")
    assert vectors.whitened(df, "v", "w", found, normalise=False).collect()[0]["w"] == [1.0, 2.0]
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        vectors.Whitening.read(spark, str(tmp_path / "x.json"))


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).option("path", str(folder / "o")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.read.parquet(str(folder / "o")).collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"messages": [{"role": "user", "content": "x"}]}\n{\n')
    assert sorted(r["fault"] for r in run(streaming.chat_lines(spark, str(tmp_path / "in")), tmp_path / "s")) == ["", "invalid JSON"]
    rows = [(1, "2024-01-01 00:00:00", "short"), (1, "2024-01-01 01:00:00", "short"), (2, "2024-01-02 00:00:00", "w " * 300)]
    spark.createDataFrame(rows, "mention_id long, t string, citation_content string").select("mention_id", F.to_timestamp("t").alias("loaded_at"), "citation_content").write.parquet(str(tmp_path / "rows"))
    read = spark.readStream.schema("mention_id long, loaded_at timestamp, citation_content string").parquet(str(tmp_path / "rows"))
    got = run(streaming.flagged(streaming.new_rows(read)), tmp_path / "t")
    assert sorted((r["mention_id"], r["flag"]) for r in got) == [(1, "short"), (2, "")]
    windows = streaming.flag_windows(streaming.flagged(read), delay="0 seconds")
    assert {(r["flag"], r["n"]) for r in run(windows, tmp_path / "u")} <= {("short", 2), ("", 1)}
