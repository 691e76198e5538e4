from __future__ import annotations

import json
import os

import pytest

from calltide.sources import calllog


def log(spark, path, **options):
    calllog.register(spark)
    return spark.read.format("calllog").options(path=str(path), **options).load()


def test_ranges_meet_at_lines(spark, tmp_path):
    lines = [json.dumps({"n": k, "t": "é" * (k % 37)}, ensure_ascii=False) for k in range(120)] + ["", "not json", "  ", '{"n": 500}']
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())  # no line end at the end
    (tmp_path / "b.jsonl").write_bytes(b"[1]\n\n")
    (tmp_path / "_hidden.jsonl").write_bytes(b"{}\n")
    raw = (tmp_path / "a.jsonl").read_bytes()
    for size in (1, 2, 7, 50, 10**6):
        cut = [x for r in calllog._cut("a.jsonl", 0, len(raw), size) for x in calllog._lines(str(tmp_path), r)]
        assert [line.decode() for _, line in cut] == lines and all(raw[o : o + len(line)] == line for o, line in cut)
    for size in (300, 10**6):
        got = log(spark, tmp_path, rangeBytes=size).collect()
        assert sorted((r.file, r.value, r.bad) for r in got) == sorted([("a.jsonl", x, x == "not json") for x in lines if x.strip()] + [("b.jsonl", "[1]", False)])
        assert all(raw[r.offset :].startswith(r.value.encode()) for r in got if r.file == "a.jsonl")
    assert sorted(map(tuple, calllog.bad_lines(log(spark, tmp_path)).collect())) == [("a.jsonl", 122, 1), ("b.jsonl", 1, 0)]
    assert log(spark, tmp_path / "none").count() == 0


def rows(spark, path):
    return sorted((r.k, r.t) for r in calllog.fields(log(spark, path), "k long, t string").collect())


def test_jobs_that_stop_leave_nothing(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text('{"k": -1, "t": "old"}\n')
    one = spark.createDataFrame([(k, f"ü{k}") for k in range(20)] + [(99, None)], "k long, t string").repartition(3)
    log(spark, tmp_path)
    write = lambda df, mode: df.write.format("calllog").mode(mode).save(str(tmp_path))
    write(one, "append")
    want = sorted([(-1, "old"), *((k, f"ü{k}") for k in range(20))])
    assert sorted(r for r in rows(spark, tmp_path) if r[1]) == want
    bad = one.selectExpr("CASE WHEN k = 13 THEN raise_error('stop') ELSE k END AS k", "t")
    with pytest.raises(Exception, match="stop"):
        write(bad, "append")
    (tmp_path / "part-left-by-a-crash.jsonl").write_text('{"k": 7, "t": "orphan"}\n')
    assert sorted(r for r in rows(spark, tmp_path) if r[1]) == want
    write(spark.createDataFrame([(5, "only")], "k long, t string"), "overwrite")
    assert rows(spark, tmp_path) == [(5, "only")]


def test_streams_take_each_line_once_over_restarts(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    calllog.register(spark)

    def run(checkpoint):
        lines = spark.readStream.format("calllog").option("path", str(source)).load()
        out = calllog.fields(lines, "k long, t string").select("k", "t")
        query = out.writeStream.format("calllog").option("query", "copy").option("checkpointLocation", str(tmp_path / checkpoint)).start(str(sink))
        query.processAllAvailable()
        query.stop()
        assert query.exception() is None

    put = lambda name, text: (source / name).open("a").write(text)
    put("a.jsonl", '{"k":1,"t":"x"}\n{"k":2,"t":"y"}\n{"k":3,"t":"half')
    run("ck")
    assert rows(spark, sink) == [(1, "x"), (2, "y")]
    put("a.jsonl", ' written"}\n')
    put("b.jsonl", '{"k":4,"t":"z"}\nbad\n')
    run("ck")
    assert rows(spark, sink) == [(1, "x"), (2, "y"), (3, "half written"), (4, "z")]
    # stopped after the manifest and before Spark's own commit: the batch comes again and changes nothing
    last = max((tmp_path / "ck" / "commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    for p in (last, last.with_name(f".{last.name}.crc")):
        if p.exists():
            os.unlink(p)
    run("ck")
    assert rows(spark, sink) == [(1, "x"), (2, "y"), (3, "half written"), (4, "z")]
