"""The replay by windows against one event after the other."""

import math
import random

from scrollmill.sources import kimi_code

EVENT = "dir string, line long, op string, text string, time string, id string, count double, model string"


def one_by_one(events: list[tuple]) -> list[dict]:
    """Messages that stand at the end: role, text parts, time, upstream id, model.

    An event is (op, text, time, id, count, model).
    """
    log: list[dict] = []
    waiting: list[dict] = []
    steps: dict[str, dict] = {}
    running, floor = None, 0
    for op, text, time, id_, count, model in events:
        if op in ("prompt", "user", "assistant"):
            match = next((w for w in waiting if op == "user" and w["parts"] == [text]), None)
            if match:
                waiting.remove(match)
                match["time"], match["id"] = time or match["time"], id_ or match["id"]
                continue
            entry = {"role": "assistant" if op == "assistant" else "user", "parts": [text], "time": time, "id": None if op == "prompt" else id_, "model": None}
            log.append(entry)
            if op == "prompt":
                waiting.append(entry)
        elif op == "step":
            running = steps[id_] = {"role": "assistant", "parts": [], "time": time, "id": id_, "model": None}
            log.append(running)
        elif op == "part":
            if id_ in steps:
                steps[id_]["parts"].append(text)
        elif op == "end":
            steps.pop(id_, None)
            running = None if running and running["id"] == id_ else running
        elif op == "model":
            if running and model:
                running["model"] = model
        else:
            if op == "undo":
                users = [k for k in range(floor, len(log)) if log[k]["role"] == "user"]
                if count > 0:
                    del log[users[-math.ceil(count)] if math.ceil(count) <= len(users) else floor :]
            else:
                floor = len(log)
            waiting, steps, running = [], {}, None
    return log


def messages(events):
    rows = []
    for n, m in enumerate(one_by_one(events)):
        text = "\n".join(m["parts"])
        if text:
            rows.append((n, m["id"], m["role"], m["time"], text, m["model"]))
    return rows


def replayed(spark, sessions):
    rows = [(f"d{n}", 3 * k + 1, *e) for n, events in enumerate(sessions) for k, e in enumerate(events)]
    random.Random(1).shuffle(rows)
    found = {n: [] for n in range(len(sessions))}
    for r in kimi_code.replay(spark.createDataFrame(rows, EVENT)).collect():
        found[int(r.dir[1:])].append((r.ord, r.upstream_id, r.role, r.time, r.text, r.model_id))
    return [sorted(found[n]) for n in range(len(sessions))]


e = lambda op, text=None, id_=None, count=0.0, model=None, time="t": (op, text, time, id_, count, model)


def test_undo_and_prompts(spark):
    log = [e("prompt", "hi"), e("user", "hi", "u1", time="t2"), e("step", id_="s1"), e("model", model="m"), e("part", "yo", "s1"), e("end", id_="s1"), e("part", "late", "s1"), e("prompt", "bye"), e("undo", count=1.0)]
    floor = [e("user", "a"), e("clear"), e("user", "b"), e("assistant", "c"), e("undo", count=5.0)]
    huge = [e("user", "a"), e("user", "b"), e("undo", count=1e300), e("assistant", "c"), e("undo", count=-1e300), e("undo", count=0.5)]
    got = replayed(spark, [log, floor, huge, [e("undo", count=1.0)]])
    assert got[0] == [(0, "u1", "user", "t2", "hi", None), (1, "s1", "assistant", "t", "yo", "m")]
    assert [m[4] for m in got[1]] == ["a"]
    assert got[2] == messages(huge) == [] and got[3] == []


def some_session(rng, n):
    ids, texts, open_ = ["s1", "s2", ""], ["a", "b", "c d"], []
    events = []
    for k in range(n):
        op = rng.choice(["prompt", "prompt", "user", "user", "assistant", "step", "step", "part", "part", "part", "end", "model", *(["undo"] if rng.random() < 0.5 else []), *(["clear"] if rng.random() < 0.2 else [])])
        text = rng.choice(texts) + (str(k) if op == "part" else "") if op in ("prompt", "user", "assistant", "part") else None
        id_ = rng.choice(ids) if op in ("step", "part", "end") else rng.choice([None, "", f"m{k}"])
        events.append((op, text, rng.choice([None, f"t{k}"]), id_, float(rng.choice([0, 0.5, 1, 1, 1, 2, 3, -1, 50])) if op == "undo" else 0.0, rng.choice([None, "", f"model{k}"]) if op == "model" else None))
    return events


def test_windows_equal_one_event_after_the_other(spark):
    rng = random.Random(20)
    sessions = [some_session(rng, rng.choice([1, 2, 5, 10, 30, 120])) for _ in range(400)] + [some_session(rng, 4000)]
    got = replayed(spark, sessions)
    for n, events in enumerate(sessions):
        assert got[n] == messages(events), n
    assert sum(map(len, got)) > 2000


def test_no_events(spark):
    assert kimi_code.replay(spark.createDataFrame([], EVENT)).count() == 0
