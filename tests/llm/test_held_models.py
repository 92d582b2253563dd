"""The model that a worker keeps between batches."""

from __future__ import annotations

import time
import weakref

from lattica.llm import text


class Model:
    pass


def waited_for(done, seconds: float = 20.0) -> bool:
    until = time.monotonic() + seconds
    while not done() and time.monotonic() < until:
        time.sleep(0.01)
    return done()


def test_an_idle_worker_lets_its_model_go(monkeypatch):
    monkeypatch.setattr(text, "IDLE_S", 0.1)
    for round_ in range(2):  # and so does one that has been idle before
        seen = weakref.ref(text.held(("idle", round_), Model))
        assert waited_for(lambda seen=seen: seen() is None)
        assert not text._HELD


def test_a_model_at_work_stays(monkeypatch):
    monkeypatch.setattr(text, "IDLE_S", 0.1)
    model = text.held("long", Model)
    time.sleep(1)
    assert text.held("long", Model) is model
    text.let_go()


def test_a_model_in_use_is_made_once(monkeypatch):
    monkeypatch.setattr(text, "IDLE_S", 1.0)
    made = []
    for _ in range(20):
        text.held("busy", lambda: made.append(1) or Model())
        time.sleep(0.1)
    assert len(made) == 1
    text.let_go()
