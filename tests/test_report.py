import json

from voicegauge.plans import report
from tests.test_sources import LOG


def test_report_in_every_form(spark, tmp_path, capsys):
    (tmp_path / "latency_log_a.csv").write_text(LOG)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "latency_log_b.csv").write_text(LOG.replace("100,10", "900,10"))
    one, two = str(tmp_path / "latency_log_a.csv"), str(tmp_path / "b" / "latency_log_b.csv")
    assert report.main([one]) == 0
    text = capsys.readouterr().out
    assert text.index("stt ") < text.index("llm_ttft") and "median" in text
    assert report.main([one, "--baseline", two, "--format", "json", "--primary", "stt"]) == 0
    got = {r["stage"]: r for r in json.loads(capsys.readouterr().out)}
    assert got["stt"]["n_pairs"] == 3 and got["stt"]["p"] is None and got["stt"]["median_a"] == 400
    assert report.main([one, "--format", "tsv", "--warmup", "1"]) == 0
    assert capsys.readouterr().out.startswith("stage\tn\t")


def test_unpaired_when_no_item_is_shared(spark):
    a = spark.createDataFrame([("r", "stt", str(i), 1, float(i)) for i in range(5)], "run string, stage string, item string, n_rep int, value double")
    b = spark.createDataFrame([("r", "stt", f"x{i}", 1, float(i + 10)) for i in range(5)], "run string, stage string, item string, n_rep int, value double")
    got = report.comparison(a, b).first()
    assert got.shift == -10 and got.delta == -1 and report.p_text(got.p) == "0.012"
