"""Calls of an analyst inside one task (I1, I2): a bounded number at a time, a deadline
each, answers taken in the order in which they come.

A call runs in a daemon thread, as Python cannot stop one that hangs.  A call that is past
its deadline is given up: its requests get the status ``timeout`` (those of a call of
several are asked once more one by one), and what it still answers is dropped.  While
``max_hung`` given-up calls are still running, further requests of the task get ``timeout``
without being asked, so that neither time nor threads grow without bound; like any failed
attempt they are asked again by the next run.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from queue import Empty, SimpleQueue

import pandas as pd

STATUSES = ("ok", "error", "timeout")


@dataclass(frozen=True)
class CallPolicy:
    """How a task asks its analyst.  By default a call has a whole Arrow batch and no
    deadline; with a deadline, or with several workers, it has ``call_rows`` requests."""

    workers: int = 1
    deadline_s: float | None = None
    call_rows: int = 1
    max_hung: int = 32

    def __post_init__(self):
        if self.workers < 1 or self.call_rows < 1 or self.max_hung < 1:
            raise ValueError("workers, call_rows and max_hung are 1 or more")
        if self.deadline_s is not None and self.deadline_s <= 0:
            raise ValueError("deadline_s is above 0")


#: status, raw reply and the time (seconds since the epoch) at which it was there
Answer = tuple[str, str, float]


def answers_of(out: pd.DataFrame, at: float) -> dict[str, Answer]:
    """Answers by key; one with another status than STATUSES, or a second one to a key, is
    an error."""
    got: dict[str, Answer] = {}
    for key, status, raw in zip(out["cache_key"], out["status"], out["raw"], strict=True):
        if key in got:
            got[key] = ("error", "analyst answered a key more than once", at)
        elif status not in STATUSES:
            got[key] = ("error", f"analyst gave the status {status!r}"[:2000], at)
        else:
            got[key] = (status, "" if raw is None else str(raw), at)
    return got


class Caller:
    """The calls of one task, over all its batches."""

    def __init__(self, analyst: Callable[[pd.DataFrame], pd.DataFrame], policy: CallPolicy):
        self.analyst, self.policy = analyst, policy
        self.done: SimpleQueue = SimpleQueue()
        self.started = self.hung = 0

    def ask(self, asked: pd.DataFrame) -> dict[str, Answer]:
        """Answers to requests of distinct keys; a key may be missing."""
        p = self.policy
        if p.deadline_s is None and p.workers == 1:
            return self._inline(asked)
        todo = deque(asked.iloc[i:i + p.call_rows] for i in range(0, len(asked), p.call_rows))
        got: dict[str, Answer] = {}
        running: dict[int, tuple[pd.DataFrame, float]] = {}
        while todo or running:
            while todo and len(running) < p.workers:
                part = todo.popleft()
                if self.hung >= p.max_hung and not self._late(running):
                    now = time.time()
                    got |= {k: ("timeout", f"not asked: {self.hung} calls hang", now)
                            for k in part["cache_key"]}
                else:
                    running[self._start(part)] = (part, time.monotonic() + (p.deadline_s or 0))
            self._collect(running, todo, got)
        return got

    def _inline(self, asked: pd.DataFrame) -> dict[str, Answer]:
        answer, failure = self._try(asked)
        if failure is None:
            return answer
        if len(asked) == 1:
            return {asked["cache_key"].iloc[0]: failure}
        got: dict[str, Answer] = {}  # the requests that fail are found one by one
        for i in range(len(asked)):
            got |= self._inline(asked.iloc[i:i + 1])
        return got

    def _try(self, part: pd.DataFrame) -> tuple[dict[str, Answer], Answer | None]:
        try:
            return answers_of(self.analyst(part), time.time()), None
        except (Exception, SystemExit) as e:  # a failure is a row, never a failed task
            return {}, ("error", f"analyst failed: {e!r}"[:2000], time.time())

    def _start(self, part: pd.DataFrame) -> int:
        self.started += 1
        number = self.started
        threading.Thread(target=lambda: self.done.put((number, *self._try(part))),
                         daemon=True).start()
        return number

    def _collect(self, running: dict, todo: deque, got: dict[str, Answer]) -> None:
        """Take one answer, or give up the calls that are past their deadline."""
        if not running:
            return
        wait = None if self.policy.deadline_s is None else \
            max(min(t for _, t in running.values()) - time.monotonic(), 0)
        try:
            number, answer, failure = self.done.get(timeout=wait)
        except Empty:
            now = time.monotonic()
            for number in [n for n, (_, t) in running.items() if t <= now]:
                self.hung += 1
                self._failed(running.pop(number)[0], todo, got, (
                    "timeout", f"no answer within {self.policy.deadline_s} s", time.time()))
            return
        if number not in running:  # given up before
            self.hung -= 1
            return
        part = running.pop(number)[0]
        if failure is None:
            got |= answer
        else:
            self._failed(part, todo, got, failure)

    def _late(self, running: dict) -> bool:
        """Whether some given-up call has ended since; answers of others wait their turn."""
        waiting = []
        while not self.done.empty():
            waiting.append(self.done.get())
        late = [x for x in waiting if x[0] not in running]
        for x in waiting:
            if x[0] in running:
                self.done.put(x)
        self.hung -= len(late)
        return bool(late)

    @staticmethod
    def _failed(part: pd.DataFrame, todo: deque, got: dict[str, Answer], why: Answer) -> None:
        if len(part) > 1:
            todo.extend(part.iloc[i:i + 1] for i in range(len(part)))
        else:
            got[part["cache_key"].iloc[0]] = why
