"""An outside program as a model: one long-lived process a partition, asked in JSON lines, with a budget of time.

The program reads lines {"id": n, "text": "..."} and writes lines {"id": n, "text": "..."} in any order. What it writes
besides is passed over. If it dies, it is started again and gets what it hasn't answered yet one by one, so that only the
input that kills it goes without an answer. What isn't answered within the budget of a batch is null, and the program is
started anew for the next one.
"""

from __future__ import annotations

import json
import queue
import subprocess
import sys
import threading
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Stands for the worker's own interpreter at the beginning of a command.
PYTHON = "{python}"
#: Fixed value: seconds for one batch.
BUDGET_S = 120.0


class Child:
    """The process of one partition."""

    def __init__(self, command: Sequence[str], budget: float = BUDGET_S):
        self.command = [sys.executable if c == PYTHON else c for c in command]
        self.budget, self.process, self.lines, self.number, self.starts = budget, None, None, 0, 0

    def _start(self) -> None:
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", errors="replace")
        self.lines, self.starts = queue.Queue(), self.starts + 1

        def read(out, lines) -> None:
            for line in out:
                lines.put(line)
            lines.put(None)

        threading.Thread(target=read, args=(self.process.stdout, self.lines), daemon=True).start()

    def close(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
        self.process = None

    def _send(self, asked: dict[int, str]) -> None:
        """Writes in a thread of its own: a program that doesn't read must not hold this one up."""

        def write(pipe) -> None:
            try:
                for n, text in asked.items():
                    pipe.write(json.dumps({"id": n, "text": text}) + "\n")
                pipe.flush()
            except (OSError, ValueError):
                pass  # it died; the reader sees that too

        threading.Thread(target=write, args=(self.process.stdin,), daemon=True).start()

    def _exchange(self, asked: dict[int, str], found: dict[int, str], until: float) -> bool:
        """Takes answers until all are there; false if the process died first."""
        if not self.process:
            self._start()
        self._send(asked)
        while any(n not in found for n in asked):
            try:
                line = self.lines.get(timeout=max(0.0, until - time.monotonic()))
            except queue.Empty:
                self.close()
                return True
            if line is None:
                self.close()
                return False
            try:
                answer = json.loads(line)
                if answer["id"] in asked and isinstance(answer["text"], str):
                    found[answer["id"]] = answer["text"]
            except (ValueError, TypeError, KeyError):
                continue
        return True

    def ask(self, texts: Sequence[str]) -> list[str | None]:
        """The answers in the order of the texts, null for those without one."""
        asked = {self.number + k: t for k, t in enumerate(texts)}
        self.number += len(texts)
        found: dict[int, str] = {}
        until = time.monotonic() + self.budget
        if asked and not self._exchange(asked, found, until):
            for n, text in asked.items():
                if n not in found and time.monotonic() < until:
                    self._exchange({n: text}, found, until)
        return [found.get(n) for n in asked]


def through_child(df: DataFrame, column: str, command: Sequence[str], out: str = "answer", batch: int = 200, budget: float = BUDGET_S) -> DataFrame:
    """Adds the program's answer to each row's text; equal texts of an Arrow batch are asked once, nulls not at all."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child = Child(command, budget)
        try:
            for part in batches:
                texts = part.column(column).to_pylist()
                asked = list(dict.fromkeys(t for t in texts if t is not None))
                known: dict[str, str | None] = {}
                for at in range(0, len(asked), batch):
                    some = asked[at : at + batch]
                    known.update(zip(some, child.ask(some), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([known.get(t) for t in texts], pa.string())], [*names, out])
        finally:
            child.close()

    return df.mapInArrow(run, schema)
