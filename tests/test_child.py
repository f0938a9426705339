"""Child processes that answer, sleep, die and garble."""

from __future__ import annotations

import time

from lectura.operators import child

LOOP = "import json, sys, time, os\nfor line in sys.stdin:\n    q = json.loads(line)\n    t = q['text']\n"
SAY = "    print(json.dumps({'id': q['id'], 'text': t.upper()}), flush=True)\n"


def program(*extra: str) -> list[str]:
    return [child.PYTHON, "-c", LOOP + "".join(f"    {x}\n" for x in extra) + SAY]


def asked(command, texts, budget=20.0):
    made = child.Child(command, budget)
    try:
        return made.ask(texts), made
    finally:
        made.close()


def test_answers_in_order_from_one_process():
    made = child.Child(program(), 20)
    assert made.ask(["a", "b\nc", "ü"]) == ["A", "B\nC", "Ü"] and made.ask([]) == [] and made.ask(["d"]) == ["D"]
    assert made.starts == 1
    made.close()


def test_answers_in_any_order():
    held = [child.PYTHON, "-c", "import json, sys\nq = [json.loads(sys.stdin.readline()) for _ in range(3)]\nfor x in reversed(q): print(json.dumps({'id': x['id'], 'text': x['text'] * 2}))\nsys.stdout.flush()\nsys.stdin.read()"]
    assert asked(held, ["a", "b", "c"])[0] == ["aa", "bb", "cc"]


def test_a_dying_process_loses_one_answer():
    found, made = asked(program("os._exit(1) if t == 'bad' else None"), ["a", "bad", "b", "c"])
    assert found == ["A", None, "B", "C"] and made.starts >= 2


def test_a_slow_process_is_given_up():
    began = time.monotonic()
    made = child.Child(program("time.sleep(60) if t == 'slow' else None"), 3.0)
    assert made.ask(["a", "slow", "b"]) == ["A", None, None] and time.monotonic() - began < 10
    assert made.ask(["c"]) == ["C"] and made.starts == 2
    made.close()


def test_a_garbling_process():
    noise = "print('noise', '{', flush=True) or print('[1]') or print(json.dumps({'id': -5, 'text': 'x'})) or print(json.dumps({'id': q['id'], 'text': 7}))"
    assert asked(program(noise), ["a", "b"])[0] == ["A", "B"]


def test_more_than_a_pipe_holds():
    texts = ["x" * 5000 + str(k) for k in range(200)]
    slow_reader = [child.PYTHON, "-c", "import json, sys\nq = [json.loads(x) for x in [sys.stdin.readline() for _ in range(200)]]\nfor x in q: print(json.dumps(x))\nsys.stdout.flush()\nsys.stdin.read()"]
    assert asked(slow_reader, texts)[0] == texts


def test_no_such_program(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "n int, t string")
    rows = child.through_child(frame, "t", program()).collect()
    assert sorted((r["n"], r["answer"]) for r in rows) == [(1, "A"), (2, None), (3, "A")]
    assert child.through_child(frame.limit(0), "t", program()).count() == 0
