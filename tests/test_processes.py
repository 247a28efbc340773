import os
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from speechlake.sources import processes

DDL = "id long, command array<string>, input string"


def alive(marker):
    out = []
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            if marker.encode() in open(f"/proc/{pid}/cmdline", "rb").read() and int(pid) != os.getpid():
                out.append(pid)
        except OSError:
            pass
    return out


def test_every_way_to_end(spark):
    mark = f"speechlake-test-{os.getpid()}"
    sh = lambda s: ["sh", "-c", s]
    rows = [
        (1, ["cat"], "hello\nwörld"), (2, sh("echo out; echo err >&2; exit 3"), None), (3, sh(f"sleep 97 # {mark}"), None),
        (4, sh(f"(sleep 98; : {mark}) & (trap '' TERM; sleep 98; : {mark}) & wait"), None), (5, ["/no/such/program"], None), (6, None, None), (7, [], None),
        (8, sh("kill -9 $$"), None), (9, sh("exec <&-; echo no input"), "x" * 1_000_000), (10, ["cat"], "y" * 3_000_000), (11, sh("printf '\\377'"), None),
        (12, sh(f"(sleep 99; : {mark}) & exit 0"), None), (13, sh(f"exec >&- 2>&-; sleep 96 # {mark}"), None), (14, sh("yes | head -c 9000 >&2"), None),
    ]
    start = time.time()
    got = {r["id"]: r for r in processes.run_each(spark.createDataFrame(rows, DDL).coalesce(2), "command", "input", 3.0, 0.3).collect()}
    assert time.time() - start < 40 and not alive(mark)
    assert {i: (r["status"], r["exit_code"]) for i, r in got.items()} == {
        1: ("ok", 0), 2: ("failed", 3), 3: ("timeout", None), 4: ("timeout", None), 5: ("missing", None), 6: ("missing", None), 7: ("missing", None),
        8: ("signal", -9), 9: ("ok", 0), 10: ("ok", 0), 11: ("ok", 0), 12: got[12]["status"] == "ok" and ("ok", 0) or ("timeout", None), 13: ("timeout", None), 14: ("ok", 0),
    }
    assert got[1]["stdout"] == "hello\nwörld" and (got[2]["stdout"], got[2]["stderr"]) == ("out\n", "err\n") and got[3]["stdout"] is None
    assert got[9]["stdout"] == "no input\n" and len(got[10]["stdout"]) == 3_000_000 and got[11]["stdout"] == "�" and len(got[14]["stderr"]) == 4000
    assert "no such" in got[5]["stderr"].lower() and got[6]["stderr"] == "no command"


def test_a_task_that_ends_early_leaves_no_child(spark):
    mark = f"speechlake-early-{os.getpid()}"
    df = spark.createDataFrame([(1, ["sh", "-c", f"sleep 95 # {mark}"], None)], DDL)
    assert processes.run_each(df, timeout_s=1.0, grace_s=0.2).where("status = 'timeout'").count() == 1 and not alive(mark)


def test_too_much_output():
    out = processes.run_child(["sh", "-c", "yes"], b"", 20, 0.2, 100_000)
    assert out.status == "overflow" and out.out == b""


def test_lines(spark):
    texts = ["plain", "two\nlines", "", None, "ümläut", "a" * 100_000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id long, text string, status string")
    got = {r["id"]: r for r in processes.run_lines(df, ["tr", "a-z", "A-Z"]).collect()}
    assert [got[i]["stdout"] for i in range(6)] == ["PLAIN", "TWO LINES", "", "", "üMLäUT", "A" * 100_000] and {r["status"] for r in got.values()} == {"ok"}
    one = processes.run_lines(df, ["sh", "-c", "while read x; do case $x in ü*) exit 4;; esac; echo ok; done"])
    assert {r["id"]: (r["status"], r["exit_code"]) for r in one.collect()} == {i: ("failed", 4) if i == 4 else ("ok", 0) for i in range(6)}
    silent = processes.run_lines(df.where("id = 0"), ["true"]).first()
    assert silent["status"] == "failed" and silent["stderr"] == "not one line"
    assert processes.run_lines(df.limit(0), ["cat"]).count() == 0 and processes.run_lines(df, ["no-such-program"]).where("status = 'missing'").count() == 6


def test_streams_of_rows_stay_with_their_columns(spark):
    df = spark.range(2500).withColumn("text", F.concat(F.lit("row "), F.col("id")))
    assert processes.run_lines(df.repartition(3), ["cat"]).where("stdout = text and status = 'ok'").count() == 2500


def test_outputs_are_handed_on_in_parts():
    schema = T.StructType([T.StructField("c", T.ArrayType(T.StringType())), T.StructField("t", T.StringType()), *processes._ADDED])
    rows = [(["cat"], "x" * 1_500_000), (None, None), (["cat"], "y" * 1_500_000), (["cat"], None), (["cat"], "z" * 5_000_000), (["echo"], "")]
    b = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.list_(pa.string())), pa.array([t for _, t in rows])], names=["c", "t"])
    got = list(processes.each(b, 0, 1, 60, 1, schema))
    assert [x.num_rows for x in got] == [3, 2, 1]
    out = pa.Table.from_batches(got).to_pylist()
    assert [r["status"] for r in out] == ["ok", "missing", "ok", "ok", "ok", "ok"]
    assert [r["stdout"] for r in out] == [rows[0][1], None, rows[2][1], "", rows[4][1], "\n"] and [r["t"] for r in out] == [t for _, t in rows]


def test_lines_go_in_parts():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000, None, "y" * 3_000_000, "z" * 9_000_000, "", "v"])], names=["t"])
    got = list(processes.parts(b, 0))
    assert [x.num_rows for x in got] == [2, 1, 1, 2] and pa.Table.from_batches(got).equals(pa.Table.from_batches([b]))
