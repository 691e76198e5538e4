from __future__ import annotations

from calltide.streaming import logs


def line(day, cost):
    return f'{{"timestamp":"2026-05-{day:02d}T12:00:00Z","cost_usd":{cost},"conclusion_changed":true}}\n'


def test_rows_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line(1, 0.5) + "not json\n" + line(2, '"x"'))
    metrics = logs.stream_metrics(spark, str(tmp_path / "in"))
    for k, want in ((0, 2), (1, 3)):
        logs.write_once(metrics, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
        (tmp_path / "in" / f"b{k}.jsonl").write_text(line(3, 1.5))
    assert sorted((r.cost_usd is None, r.cost_usd) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.cost_usd is not None) == [(False, 0.5), (False, 1.5)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line(1, 0.5) + line(2, 1.5) + line(28, 9.0))
    cost = logs.rolling_cost(logs.stream_metrics(spark, str(tmp_path / "in")), "1 day", "1 day")
    logs.write_once(cost, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    (tmp_path / "in" / "b.jsonl").write_text(line(29, 1.0))
    logs.write_once(cost, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((str(r.start)[:10], r.calls, r.avg_cost) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2026-05-01", 1, 0.5), ("2026-05-02", 1, 1.5)]
