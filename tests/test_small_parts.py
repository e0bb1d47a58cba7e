"""Readers, labels, timings and clients that the larger tests don't reach."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from voicegauge.functions import text as T
from voicegauge.operators import agreement, collapse, compare, pairing, sweep
from voicegauge.plans import report
from voicegauge.sources import logs, models, sinks, transcripts
from voicegauge.streaming import turns


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_labels_and_expressions(spark):
    lit = F.lit
    got = one(
        spark,
        icc=F.array(*(agreement.icc_label(lit(v)) for v in (0.4, 0.5, 0.8, 0.95))), kappa=F.array(*(agreement.kappa_label(lit(v)) for v in (-0.1, 0.2, 0.4, 0.6, 0.8, 0.81))),
        slug=T.slug(lit("_a b/c__")), delay=sweep.expected_delay(lit(500), lit(100)), tail=sweep.expected_delay(lit(500), lit(100), True),
        mic=turns.triggers_on_endpoint(lit("mic"), lit("fast"), lit("file")), fast=turns.triggers_on_endpoint(lit("file"), lit("fast"), lit("endpoint")),
        real=turns.triggers_on_endpoint(lit("file"), lit("realtime"), lit("endpoint")),
        use=sweep.usable(lit(1.5), lit(4), lit(0.9), 0.8), short=sweep.usable(lit(0.5), lit(4), lit(0.9), 0.8), apart=sweep.usable(lit(1.5), lit(4), lit(0.9), 0.8, lit(0.6), lit(9), lit(0.9)),
    )
    assert got.icc == ["poor", "moderate", "good", "excellent"] and got.kappa == ["poor", "slight", "fair", "moderate", "substantial", "almost perfect"]
    assert got.slug == "a_b_c" and (got.delay, got.tail) == (820, 965) and (got.mic, got.fast, got.real) == (True, False, True)
    assert (got.use, got.short, got.apart) == (True, False, False)
    got = one(spark, long=T.excerpt(lit("a  b\n" + "c" * 80)), short=T.excerpt(lit(" “a”  b ")))
    assert got.long == "a b " + "c" * 53 + "..." and got.short == '"a" b'
    assert report.wrapped("aa bb  cc\ndd", 5, 2) == "aa bb\n  cc dd" and report.wrapped("") == ""
    assert report.interval_text(None, 2.0) == "[-, 2.0]" and report.interval_text(None, None) == "-"


def test_timings_and_resources(spark):
    t = spark.createDataFrame([(100.0, 400.0, 900.0, 500.0, 650.0, 200.0, 1000.0, 30.0, 2e9)], "ttft_ms double, ttfc_ms double, tts_first_t_ms double, speech_end_t_ms double, final_t_ms double, stt_ms double, input_duration_ms double, eval_count double, eval_ns double")
    r = sweep.derived_timings(t).first()
    assert (r.first_chunk_fill_ms, r.ttfa_ms, r.endpoint_delay_ms, r.stt_rtf, r.tokens_per_sec) == (300, 400, 150, 0.2, 15)
    s = spark.createDataFrame([(1, 70.0), (1, 50.0), (2, 10.0)], "ts int, value double")
    assert {r.ts: r.util for r in sweep.process_utilisation(s).collect()} == {1: 100, 2: 10}
    log = spark.createDataFrame([("r", 2, "stt", 10.0, " "), ("r", 3, "other", 30.0, "A100"), ("r", 4, "stt", None, "B")], "run string, pos long, stage string, cpu_percent double, gpu_name string")
    assert collapse.known_stages(log).count() == 2 and collapse.hardware(log, ("gpu_name",)).first().gpu_name == "A100"
    assert {(r.stage, r.n, r.p50) for r in collapse.resource_table(log, ("cpu_percent",)).collect()} == {("stt", 1, 10.0), ("other", 1, 30.0), (None, 2, 20.0)}


def test_judges_scores(spark):
    s = spark.createDataFrame([("i", "clear", 4.0), ("i", "kind", 2.0), ("i", "safe", 5.0), ("i", "harm", 3.0), ("j", "clear", None)], "item string, dimension string, score double")
    rubric = spark.createDataFrame([("clear", 3.0, False), ("kind", 1.0, False), ("safe", 1.0, True), ("harm", 1.0, True)], "dimension string, weight double, safety_critical boolean")
    got = compare.rubric_scores(s, rubric).collect()
    assert [(r.item, r.quality_composite, r.safety_minimum) for r in got] == [("i", 3.5, 3.0)]
    panel = spark.createDataFrame([("i", "d", "a", 4.0), ("i", "d", "a", 2.0), ("i", "d", "b", 5.0)], "item string, dimension string, model string, score double")
    p = agreement.panel_scores(panel).first()
    assert (p.mean, p.spread) == (4.0, 2.0)
    c = spark.createDataFrame([("d", float(i) if i < 6 else None, i + 0.5) for i in range(9)], "dimension string, human double, judge double")
    got = agreement.calibrate(c, ("dimension",)).first()
    assert (got.bias, got.mae, got.rho, got.tau, got.n_lab, got.n_unl) == (0.5, 0.5, pytest.approx(1), pytest.approx(1), 6, 3)
    a = spark.createDataFrame([("i", "check::x", 1.0), ("i", "check::y", 1.0)], "item string, metric string, value double")
    kinds = compare.with_checks(compare.catalogue(spark), a, a.where("metric <> 'check::y'"))
    assert [(r.metric, r.binary, r.family) for r in kinds.where("metric like 'check::%'").collect()] == [("check::x", True, "adherence")]


def test_files(spark, tmp_path):
    (tmp_path / "averages.json").write_text('{"warmup_dropped_per_run": 3}')
    (tmp_path / "other.json").write_text('{"a": 1}')
    assert [logs.warmup_count(spark, str(tmp_path / n)) for n in ("averages.json", "other.json", "none.json")] == [3, 0, 0]
    (tmp_path / "meta.csv").write_text("filename,question,speech_end_ms\na/x.wav,why,120\nb/x.wav,how,[N/A]\ny.wav,,7\n")
    meta = logs.recording_metadata(spark, str(tmp_path / "meta.csv"))
    got = logs.with_metadata(spark.createDataFrame([("rec/y.wav",), ("z.wav",)], "filename string"), meta).collect()
    assert {r.filename: r.speech_end_ms for r in got} == {"rec/y.wav": 7.0, "z.wav": None} and meta.count() == 2
    (tmp_path / "checks.json").write_text(json.dumps({"checks": [{"type": "non_empty"}]}))
    assert transcripts.read_checks(spark, str(tmp_path / "checks.json")) == [{"type": "non_empty"}]
    (tmp_path / "bad.json").write_text(json.dumps([{"type": "no such"}]))
    with pytest.raises(ValueError, match="no such"):
        transcripts.read_checks(spark, str(tmp_path / "bad.json"))
    rows = spark.createDataFrame([("f", "o", "s", "l")], "filename string, ori_text string, stt_text string, llm_text string")
    for _ in range(2):
        sinks.append_transcripts(rows, str(tmp_path / "t"))
        sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2 and spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 2


def test_joins(spark):
    h = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "series string, at long, value double")
    assert {r.at for r in pairing.bounded_history(h, 3).collect()} == {7, 8, 9}
    f, d = (spark.createDataFrame([(x, 1) for x in xs], f"file string, {n} int") for xs, n in (("ab", "speech"), ("abc", "words")))
    assert sweep.joined_recordings(f, d, d.withColumnRenamed("words", "heard")).count() == 2
    with pytest.raises(ValueError, match="c"):
        sweep.joined_recordings(d, f)
    a = spark.createDataFrame([("What  is it", "old", 0), ("what is IT", "new", 1), ("only", "x", 2)], "stt_text string, llm_text string, pos int")
    b = spark.createDataFrame([("what is it", "other", 0)], "stt_text string, llm_text string, pos int")
    pairs = models.joined_answers(a, b)
    assert [(r.a, r.b) for r in pairs.collect()] == [("new", "other")]
    t = models.tallies(models.pairwise(pairs).withColumn("dimension", F.lit("d")), ("dimension",)).first()
    assert t.dimension == "d" and t.a + t.b + t.ties == 1


def test_http_client(spark):
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            self._say(200, {"models": []})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["prompt"])
            broken = body["prompt"] == "flaky" and asked.count("flaky") == 1
            self._say(500 if broken else 400 if body["prompt"] == "refused" else 200, {"response": f"echo {body['prompt']}", "eval_count": 3, "prompt_eval_count": 4})

        def _say(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert models.reachable(url) and not models.reachable("http://127.0.0.1:9")
    prompts = spark.createDataFrame([(1, "one"), (2, "flaky"), (3, "refused")], "item int, prompt string")
    got = {r.item: r for r in models.ask_all(prompts.coalesce(1), ["item"], models.HttpClient(url, "m")).collect()}
    server.shutdown()
    assert got[1].reply == "echo one" and got[1].tokens == 7 and got[2].reply == "echo flaky" and got[3].reply is None and "refused" in got[3].error
    calls = spark.createDataFrame([("m", r.error, r.tokens, r.seconds) for r in got.values()], "model string, error string, tokens long, seconds double")
    c = models.cost(calls).first()
    assert (c.calls, c.failures, c.tokens) == (3, 1, 14) and c.seconds > 0
