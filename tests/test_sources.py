"""Readers, records, sinks, streams, judges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from voicegauge.operators import collapse, pairing
from voicegauge.sources import logs, models, sinks, transcripts
from voicegauge.streaming import chunker, turns

LOG = "item,stage,duration_ms,cpu_percent,extra_json\n00001,stt,100,10,{}\n00001,llm_ttft,200,[N/A],{}\n00002,stt,400,,\"{\"\"k\"\": 1}\"\n00002,llm_ttft,500,20,{}\n00002,llm_ttft,700,20,{}\n00003,stt,900,20,{}\n00003,llm_ttft,1000,20,{}\n"


def test_logs(spark, tmp_path):
    for i, name in enumerate(("latency_log_b.csv", "latency_log_a.csv", "x_summary.csv")):
        (tmp_path / name).write_text(LOG)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert logs.newest_logs(spark, str(tmp_path), 1)[0].endswith("latency_log_a.csv")
    assert logs.run_log(spark, str(tmp_path)).endswith("latency_log_b.csv")
    assert len(logs.newest_logs(spark, str(tmp_path), 5)) == 2
    log = logs.typed_log(logs.read_log_text(spark, [str(tmp_path / "latency_log_a.csv")]), warmup=1)
    items = collapse.collapse_items(log)
    assert {r.stage: r.median for r in collapse.stage_summary(items).collect()} == {"stt": 650, "llm_ttft": 800}
    assert log.where("cpu_percent is null").count() == 1 and [r.pos for r in log.orderBy("pos").collect()] == sorted(r.pos for r in log.collect())
    assert logs.read_log_text(spark, []).count() == 0


def test_options():
    assert logs.check_quantiles([90, 0.95]) == [0.5, 0.9, 0.95]
    for bad in ({"log_count": 0}, {"confidence": 0.4}, {"warmup": -1}):
        with pytest.raises(ValueError):
            logs.check_options(**bad)
    with pytest.raises(ValueError):
        logs.check_quantiles([0])


KEY = 'id,question,answer,is_impossible,plausible_answers\n1,Where?,Paris,False,\n2,Who?,,True,Bob\n3,How many?,"""40,000""",False,\n4,Why?,"some passage, ""quoted"",the reason",False,\n5,None?,,False,\n6,List?,"[\'a\', \'b\']",no,\n'


def test_answer_key(spark, tmp_path):
    (tmp_path / "key.csv").write_text(KEY)
    got = {r.key: (r.reference_answers, r.answer_unsupported) for r in transcripts.read_answer_key(spark, str(tmp_path / "key.csv")).collect()}
    assert got["1"] == (["Paris"], False) and got["who?"] == (["Bob"], True) and got["3"] == (["40,000"], False) and got["4"] == (["the reason"], False) and "5" not in got and got["6"] == (["a", "b"], False)
    (tmp_path / "bad.csv").write_text("id,question\n1,x\n")
    with pytest.raises(ValueError):
        transcripts.read_answer_key(spark, str(tmp_path / "bad.csv"))


def test_records(spark, tmp_path):
    rows = [{"filename": "a/00001.wav", "stt_text": "Where", "llm_text": "Paris."}, {"input_text": "who  IS", "response": "Bob"}, {"item_id": "z", "stt_text": "", "llm_text": ""}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    t = transcripts.normal_transcripts(transcripts.read_transcripts(spark, str(tmp_path / "t.jsonl")))
    spec = spark.createDataFrame([("who is", "crisis", [], ["call"], [], "", None, False)], transcripts.SPEC)
    key = spark.createDataFrame([("00001", ["Paris"], False), ("z", ["y"], True)], "key string, reference_answers array<string>, answer_unsupported boolean")
    got = {r.item_id: r for r in transcripts.build_records(t, spec, key).collect()}
    assert set(got) == {"00001", "item002", "z"} and got["00001"].reference_answers == ["Paris"] and got["item002"].category == "crisis" and got["item002"].safety_critical and got["item002"].must_include == ["call"] and got["z"].answer_unsupported and got["00001"].category == "unspecified"
    (tmp_path / "bad.jsonl").write_text('{"stt_text": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        transcripts.read_transcripts(spark, str(tmp_path / "bad.jsonl")).collect()


def test_yaml_and_ratings(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("- stt_text: hi\n  llm_text: ho\n")
    assert transcripts.read_transcripts(spark, str(tmp_path / "t.yaml")).first().llm_text == "ho"
    (tmp_path / "r.csv").write_text("item_id,rater_id,dimension,score\n1,a,d,4\n1,a,d,5\n2,a,d,\n")
    from voicegauge.operators.agreement import last_ratings

    assert last_ratings(transcripts.read_ratings(spark, str(tmp_path / "r.csv"))).collect()[0].score == 5
    (tmp_path / "bad.csv").write_text("item_id,rater_id,dimension,score\n1,a,d,good\n")
    with pytest.raises(Exception, match="not a score"):
        transcripts.read_ratings(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "rubric.yaml").write_text("dimensions:\n- {id: warmth, anchors: {1: low, 5: high}, weight: 2}\n")
    assert transcripts.read_rubric(spark, str(tmp_path / "rubric.yaml")).first().high == 5
    (tmp_path / "scen.yaml").write_text("items:\n- {item_id: A, stt_text: Hi There, must_include: x}\n")
    assert {r.key for r in transcripts.read_scenarios(spark, str(tmp_path / "scen.yaml")).collect()} == {"a", "hi there"}


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, [1, 2])], "i int, l array<int>")
    both = sinks.union_columns([a, b])
    sinks.write_bundle({"all": both}, str(tmp_path))
    back = spark.read.option("header", "true").csv(str(tmp_path / "all"))
    assert set(back.columns) == {"i", "s", "l"} and back.where("i = 2").first().l == "[1,2]"
    sinks.write_table(both, str(tmp_path / "t"), ["i"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_overlap_against_a_loop(spark):
    samples = [("g", 0, 1.0), ("g", 10, 2.0), ("g", 25, 4.0), ("g", 26, 8.0)]
    spans = [("g", "a", 5, 20), ("g", "b", 0, 26), ("g", "c", -5, 5), ("g", "d", 30, 40)]
    got = {r.span: r["mean"] for r in pairing.overlap_means(spark.createDataFrame(samples, "series string, at long, value double"), spark.createDataFrame(spans, "series string, span string, start long, end long"), 7).collect()}
    assert got["a"] == pytest.approx((5 * 2 + 10 * 4) / 15) and got["b"] == pytest.approx((10 * 2 + 15 * 4 + 8) / 26) and got["c"] is None and got["d"] is None


@pytest.mark.parametrize(("pieces", "want"), [
    (["It is ", "3.", "14 now. ", "Yes"], ["It is 3.14 now.", "Yes"]), (["a. Hello there! ", '"Quoted." rest'], ["a. Hello there!", '"Quoted."', "rest"]), (["x" * 150], ["x" * 140, "x" * 10]), (["word " * 40], [("word " * 28).strip(), ("word " * 12).strip()]),
    (["...", "\n", "Go on: "], ["...\nGo on:"]), ([], []), (["3."], ["3."]),
])
def test_chunker(pieces, want):
    assert chunker.chunks(pieces) == want


def test_turn_rules(spark):
    df = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 2, 3, "c"), ("s", 1, 4, "late"), ("t", 1, 9, "d")], "key string, generation int, at int, text string")
    assert sorted(r.text for r in turns.superseded(df).collect()) == ["a", "b", "c", "d"]
    assert {r.key: r.value for r in turns.latest(df, "key", "at", "text").collect()} == {"s": "late", "t": "d"}
    assert turns.cumulative(df.where("key = 's'"), "key", "at", "text").orderBy(F.desc("at")).first().so_far == "a b c late"


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "Hello there. How", False), ("s", 1, " are you? Fine", True), ("t", 0, "Hm", True)], "session string, seq int, piece string, last boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = chunker.stream_chunks(stream).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.chunk for r in spark.sql("select * from chunks where session = 's' order by chunk_no").collect()] == ["Hello there.", "How are you?", "Fine"]
    q = turns.latest(stream, "session", "seq", "piece").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.session: r.seq for r in spark.sql("select * from latest").collect()} == {"s": 1, "t": 0}


def test_idle_sessions_are_flushed(spark, tmp_path):
    import time

    df = spark.createDataFrame([("s", 0, "Hello there. How", False)], "session string, seq int, piece string, last boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = chunker.stream_chunks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_seconds=1)
    q = stream.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    end = time.monotonic() + 60
    while spark.table("idle").count() < 2 and time.monotonic() < end:
        time.sleep(0.5)
    q.stop()
    assert [r.chunk for r in spark.table("idle").orderBy("chunk_no").collect()] == ["Hello there.", "How"]


def test_sessions(spark):
    df = spark.sql("select * from values ('u', timestamp '2024-01-01 00:00:00'), ('u', timestamp '2024-01-01 00:03:00'), ('u', timestamp '2024-01-01 01:00:00') t(user, ts)")
    assert sorted(r.n for r in turns.sessions(df).collect()) == [1, 2]


def test_judges(spark):
    items = spark.createDataFrame([("i", "why?", "because")], "item string, question string, answer string")
    rubric = spark.createDataFrame([("warmth", 1, 5)], "dimension string, low int, high int")
    got = models.rubric_judge(items, rubric, samples=3).collect()
    assert len(got) == 3 and all(1 <= r.score <= 5 for r in got)
    pairs = spark.createDataFrame([("i", "q", "x", "y"), ("j", "q", "w", "z")], "item string, question string, a string, b string")
    v = models.pairwise(pairs)
    assert all(r.winner in "AB" if r.consistent else r.winner == "tie" for r in v.collect()) and models.tallies(v).first().a is not None

    def down(prompt):
        raise ConnectionError("down")

    failed = models.ask_all(items.select("item", F.col("question").alias("prompt")), ["item"], down).first()
    assert failed.reply is None and failed.error == "down"


def test_runs_of_a_grid(spark, tmp_path):
    from voicegauge.operators import contrasts
    from voicegauge.sources import runs

    for name, tag in (("02-b", "llama3.1:8b-instruct-q4_K_M"), ("01-a", "llama3.1:8b-instruct-fp16"), ("skip", None)):
        d = tmp_path / name
        d.mkdir()
        if tag:
            (d / "transcripts.jsonl").write_text('{"stt_text": "a", "llm_text": "b"}\n')
            (d / "config_used.yaml").write_text(f"ollama_model: {tag}\ntemperature: 0.0\nstt_engine: vosk\nvosk_model: m/vosk-model-small\nnested: {{a: 1}}\n")
            (d / "system_prompt.txt").write_text("short.txt\n\nBe brief.\n")
    got = runs.identify_runs(spark, str(tmp_path))
    assert {r.cell: (r.ord, r.quantization, r.recognizer, r.setting) for r in got.collect()} == {"02-b": (2, "q4_K_M", "vosk-small-cpu", "t0"), "01-a": (1, "fp16", "vosk-small-cpu", "t0")}
    edges = contrasts.contrast_edges(got).collect()
    assert {(e.kind, e.baseline[-4:], e.contrast[-4:]) for e in edges} == {("quantization", "01-a", "02-b"), ("cross_model", "01-a", "02-b")}
    assert runs.read_prompt(spark, str(tmp_path / "01-a")) == "Be brief." and runs.read_settings(spark, str(tmp_path / "skip")) == {}
