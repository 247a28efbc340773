"""External programs over rows: supervised children that get their input by pipe, have a time limit, and leave nothing behind.

A program that fails, hangs or isn't there makes a row that says so, not a failed task. Every child leads a process group
of its own; at the time limit, and whenever its task ends for any reason, the group is asked to end and, after a grace
time, killed, so grandchildren go as well. Output is read as it comes, to a bound per stream, so a child that prints
without end neither blocks nor fills the memory.
"""

from __future__ import annotations

import contextlib
import os
import selectors
import signal
import subprocess
import time
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Seconds that a program may take, and that it has to end after being asked to.
TIMEOUT_S, GRACE_S = 7200.0, 5.0
#: Bytes that are kept of standard output, of standard error (its end), and written at once.
MOST_OUT, MOST_ERR, PIECE = 64_000_000, 4_000, 65_536
#: Bytes of rows and their outputs that a task gathers, unless one row has more.
HELD = 4_000_000


@dataclass
class Outcome:
    """status: ok, failed (another code than 0), signal, timeout, overflow (too much output), missing (couldn't be started)."""

    status: str
    code: int | None = None
    out: bytes = b""
    err: bytes = b""


def end_group(child: subprocess.Popen, grace_s: float) -> None:
    """Asks a child's process group to end and kills what is left of it."""
    with contextlib.suppress(ProcessLookupError, PermissionError):
        os.killpg(child.pid, signal.SIGTERM)
        deadline = time.monotonic() + grace_s
        while time.monotonic() < deadline:
            child.poll()
            os.killpg(child.pid, 0)  # raises once nobody is left
            time.sleep(0.01)
        os.killpg(child.pid, signal.SIGKILL)
    child.wait()


def run_child(command: list[str], data: bytes, timeout_s: float, grace_s: float, most_out: int = MOST_OUT) -> Outcome:
    """Runs a program with data as its standard input."""
    try:
        child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    except (OSError, ValueError) as e:
        return Outcome("missing", err=str(e).encode())
    deadline, got, at, status = time.monotonic() + timeout_s, {"out": bytearray(), "err": bytearray()}, 0, ""
    view = memoryview(data)
    try:
        with selectors.DefaultSelector() as ready:
            for stream, kind in ((child.stdin, "in"), (child.stdout, "out"), (child.stderr, "err")):
                os.set_blocking(stream.fileno(), False)
                ready.register(stream, selectors.EVENT_WRITE if kind == "in" else selectors.EVENT_READ, kind)
            while ready.get_map() and not status:
                left = deadline - time.monotonic()
                if left <= 0:
                    status = "timeout"
                for key, _ in ready.select(max(0.0, min(left, 1.0))) if not status else []:
                    if key.data == "in":
                        try:
                            at += os.write(key.fd, view[at : at + PIECE])
                        except BrokenPipeError:  # it doesn't want to read on
                            at = len(data)
                        if at == len(data):
                            ready.unregister(child.stdin)
                            child.stdin.close()
                        continue
                    piece = os.read(key.fd, PIECE)
                    if not piece:
                        ready.unregister(key.fileobj)
                    got[key.data] += piece
                    if key.data == "err":
                        del got["err"][:-MOST_ERR]
                    elif len(got["out"]) > most_out:
                        status = "overflow"
        while not status and child.poll() is None:  # its streams are closed, it goes on
            if time.monotonic() >= deadline:
                status = "timeout"
            time.sleep(0.005)
    finally:
        end_group(child, grace_s)
        for stream in (child.stdin, child.stdout, child.stderr):
            with contextlib.suppress(BrokenPipeError):
                stream.close()
    code = child.returncode
    if status:
        return Outcome(status, None, b"", bytes(got["err"]))
    return Outcome("ok" if code == 0 else "failed" if code > 0 else "signal", code, bytes(got["out"]), bytes(got["err"]))


_ADDED = [T.StructField("status", T.StringType()), T.StructField("exit_code", T.IntegerType()), T.StructField("stdout", T.StringType()), T.StructField("stderr", T.StringType())]


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def each(b: pa.RecordBatch, command_at: int, text_at: int | None, timeout_s: float, grace_s: float, schema: T.StructType):
    """b's rows with their programs' outcomes, in parts."""
    done, size, start = [], 0, 0
    for i in range(b.num_rows):
        command = b.column(command_at)[i].as_py()
        data = (b.column(text_at)[i].as_buffer() if text_at is not None else None) or b""
        done.append(run_child([x or "" for x in command], data, timeout_s, grace_s) if command else Outcome("missing", err=b"no command"))
        size += len(data) + len(done[-1].out) + len(done[-1].err)
        if size >= HELD or i == b.num_rows - 1:
            yield _with(b.slice(start, len(done)), done, schema)
            done, size, start = [], 0, i + 1


def parts(b: pa.RecordBatch, text_at: int):
    """b in slices of HELD bytes of text, or of one row."""
    size, start = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_pylist()):
        if i > start and size + n > HELD:
            yield b.slice(start, i - start)
            size, start = 0, i
        size += n
    if b.num_rows:
        yield b.slice(start)


def run_each(df: DataFrame, argument: str = "command", stdin: str | None = None, timeout_s: float = TIMEOUT_S, grace_s: float = GRACE_S) -> DataFrame:
    """df with status, exit_code, stdout and stderr of the program that each row names in `argument` (array of strings), with
    the text in column `stdin` as its input. A task holds the outputs of some rows only, HELD bytes or one row's.

    Rows of a task run one after the other. A null or empty command has the status missing. stdout is null but for the
    statuses ok, failed and signal; stderr is its last 4000 bytes. Columns of df named like an output are replaced.
    """
    df = df.drop(*[f.name for f in _ADDED])
    names = df.columns
    schema = T.StructType([*df.schema.fields, *_ADDED])

    def run(batches):
        for b in batches:
            yield from each(b, names.index(argument), names.index(stdin) if stdin else None, timeout_s, grace_s, schema)

    return df.mapInArrow(run, schema)


def _with(b: pa.RecordBatch, done: list[Outcome], schema: T.StructType) -> pa.RecordBatch:
    ran = {"ok", "failed", "signal"}
    new = [
        pa.array([o.status for o in done], pa.string()), pa.array([o.code for o in done], pa.int32()),
        pa.array([_text(o.out) if o.status in ran else None for o in done], pa.string()), pa.array([_text(o.err) for o in done], pa.string()),
    ]
    return pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)


def run_lines(df: DataFrame, command: list[str], column: str = "text", timeout_s: float = TIMEOUT_S, grace_s: float = GRACE_S) -> DataFrame:
    """df with status, exit_code, stdout and stderr of one program per batch of rows (HELD bytes), which gets the values of `column` as
    lines and answers each line with one.

    Line breaks within a value go as blanks, and a null as an empty line. If a batch's child fails, or answers with another
    number of lines, each of its rows is run again by itself, so that one bad row spoils no other; a row whose own child
    answers with other than one line has the status failed. Columns of df named like an output are replaced.
    """
    df = df.drop(*[f.name for f in _ADDED])
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *_ADDED])

    def run(batches):
        for b in (x for batch in batches for x in parts(batch, at)):
            lines = [(x or "").replace("\n", " ").encode() for x in b.column(at).to_pylist()]
            whole = run_child(command, b"".join(x + b"\n" for x in lines), timeout_s, grace_s) if lines else Outcome("ok")
            answers = whole.out.split(b"\n")[:-1]
            if whole.status == "ok" and len(answers) == len(lines):
                done = [Outcome("ok", 0, a) for a in answers]
            else:
                done = []
                for x in lines:
                    one = run_child(command, x + b"\n", timeout_s, grace_s)
                    if one.status == "ok" and one.out.count(b"\n") != 1:
                        one = Outcome("failed", one.code, one.out, b"not one line")
                    done.append(Outcome(one.status, one.code, one.out.removesuffix(b"\n"), one.err))
            yield _with(b, done, schema)

    return df.mapInArrow(run, schema)
