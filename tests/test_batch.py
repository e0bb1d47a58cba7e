"""Evaluate, batch and compare from run folders to their bundles."""

import json

import pytest

from voicegauge.operators import collapse
from voicegauge.plans import batch

HEAD = "item,stage,duration_ms,cpu_percent,input_mode,extra_json\n"


@pytest.fixture(scope="module")
def grid(tmp_path_factory):
    root = tmp_path_factory.mktemp("grid")
    for name, tag, slow in (("01-a", "llama3.1:8b-instruct-fp16", 0), ("02-b", "llama3.1:8b-instruct-q4_K_M", 400)):
        d = root / name
        d.mkdir()
        n = 8 if slow else 9
        lines = [{"filename": f"i{i}.wav", "ori_text": f"where is city {i}", "stt_text": f"where is city {i}" if i != 2 or not slow else "where is it", "llm_text": "" if i == 5 else f"City {i} is here."} for i in range(n)]
        (d / "transcripts.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
        (d / "config_used.yaml").write_text(f"ollama_model: {tag}\ntemperature: 0.0\nstt_engine: vosk\nvosk_model: m/vosk-model-small\nnum_ctx: {2048 + slow}\nmode: gpu\n")
        rows = [f'i{i},ttfa,{1000 + i + slow},10,mic,{{}}\ni{i},llm_eval,300,30,mic,"{{""eval_tokens"": {i}, ""tokens_per_sec"": 33}}"\n' for i in range(n)]
        (d / "latency_log_x.csv").write_text(HEAD + "".join(rows))
    key = root / "key.csv"
    key.write_text("id,answer,plausible_answers,is_impossible\n" + "".join(f"i{i},city {i},,{'true' if i == 1 else 'false'}\n" for i in range(9)))
    return root, str(key)


def test_batch_bundle(spark, grid, tmp_path, capsys):
    root, key = grid
    tables = batch.run_batch(spark, str(root), answers=key, resamples=200)
    board = {r.cell: r for r in tables["leaderboard"].collect()}
    assert len(tables["leaderboard"].columns) == 67
    a, b = board["01-a"], board["02-b"]
    assert (a.n_items, a.n_empty_responses, b.n_items) == (9, 1, 8) and a.quantization == "fp16" and a.num_ctx == 2048 and a.mode == "gpu"
    assert (a.ttfa_ms_median, b.ttfa_ms_median) == (1004, 1403.5) and a.ttfa_ms_p90 == pytest.approx(1007.2) and a.generated_tokens_median == 4
    assert a.cpu_percent == 20 and a.adherence_item_strict == pytest.approx(8 / 9) and a.n_answerable_short_span == 8 and a.answer_items_scored == 9 and a.results_dir == "runs/01-a"
    index = {r.kind: r for r in tables["comparison_index"].collect()}
    assert index["quantization"].degraded >= 1
    assert {(r.kind, r.property) for r in tables["unequal_inputs"].collect()} == {("quantization", "num_ctx"), ("cross_model", "num_ctx")}
    found = {r.kind: (r.missing, r.extra, r.differing) for r in tables["item_differences"].collect()}
    assert found["quantization"] == (1, 0, 1)
    out = str(tmp_path / "bundle")
    batch.write({k: tables[k] for k in ("all_items", "leaderboard", "input_reference")}, out)
    assert spark.read.parquet(f"{out}/all_items").count() == 17 and spark.read.json(f"{out}/manifest").count() == 3
    assert spark.read.option("header", "true").csv(f"{out}/input_reference").first().n_items == "9"
    from voicegauge.sources import runs

    assert batch.copy_artefacts(runs.discover_runs(spark, str(root)), out) == 2
    assert (tmp_path / "bundle" / "runs" / "01-a" / "config_used.yaml").read_text().startswith("ollama_model")


def test_commands(spark, grid, tmp_path, capsys):
    root, key = grid
    assert batch.main(["evaluate", str(root / "01-a"), "--answers", key]) == 0
    assert "adherence" not in capsys.readouterr().err
    assert batch.main(["compare", str(root / "01-a"), str(root / "02-b"), "--resamples", "100"]) == 0
    assert "comparison_index" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no run"):
        batch.load(spark, str(tmp_path), batch.CHECKS)


def test_reports_that_cannot_be_written(capsys, tmp_path):
    from voicegauge.plans.report import save

    assert save("text", str(tmp_path / "r.txt")) and (tmp_path / "r.txt").read_text() == "text\n"
    assert not save("text", str(tmp_path / "no" / "r.txt")) and "not written" in capsys.readouterr().err


def test_log_warnings(spark):
    rows = [("r1", 0, "a", "stt", 1.0, "mic", '{"speech_end_source": "vad"}'), ("r1", 1, "a", "stt", 3.0, "mic", '{"speech_end_source": "label"}'), ("r1", 2, "b", "stt", 1.0, "file", None), ("r2", 0, "a", "stt", 1.0, "", '{"system_prompt": "x"}')]
    log = spark.createDataFrame(rows, "run string, pos long, item string, stage string, value double, input_mode string, extra_json string")
    got = {(r.kind, r.detail) for r in collapse.log_warnings(log, collapse.collapse_items(log), ("input_mode",)).collect()}
    assert got == {("mixed settings", "input_mode: (unset)|file|mic"), ("no input mode", "ttfa counts from the start of processing"), ("ends of speech", "label, vad"), ("collapsed repeats", "1"), ("runs of different sizes", "1, 2"), ("few items", "2")}
