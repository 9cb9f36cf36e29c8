"""The thin service plane in plain Python: a response cache, rate limits, usage, and an answer's events."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator


class ResponseCache:
    """Answers by version and question, least recently used first out; errors and cut answers aren't kept."""

    def __init__(self, visible: str, cap: int = 500, path: str | None = None):
        self.version = hashlib.sha1(visible.encode()).hexdigest()[:8]  # noqa: S324
        self.cap, self.path = cap, path
        self.items: OrderedDict[str, list] = OrderedDict()
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.items.update((k, v) for k, v in json.load(f).items() if k.startswith(self.version + ":"))

    def key(self, question: str) -> str:
        return f"{self.version}:{' '.join(question.lower().split())}"

    def get(self, question: str) -> list | None:
        k = self.key(question)
        if k in self.items:
            self.items.move_to_end(k)
            return self.items[k]
        return None

    def put(self, question: str, events: list) -> None:
        if any(e.get("type") == "error" or e.get("cut") for e in events):
            return
        self.items[self.key(question)] = events
        self.items.move_to_end(self.key(question))
        while len(self.items) > self.cap:
            self.items.popitem(last=False)

    def save(self) -> None:
        if self.path:
            part = self.path + ".part"
            with open(part, "w", encoding="utf-8") as f:
                json.dump(self.items, f)
            os.replace(part, self.path)


class RateLimit:
    """At most ``most`` calls of a caller within ``window`` seconds."""

    def __init__(self, most: int = 5, window: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.window, self.clock = most, window, clock
        self.calls: dict[str, deque] = {}

    def allow(self, caller: str) -> bool:
        now, q = self.clock(), self.calls.setdefault(caller, deque())
        while q and now - q[0] >= self.window:
            q.popleft()
        if len(q) >= self.most:
            return False
        q.append(now)
        return True


class Usage:
    """Counts of tokens and errors; degraded when an hour had more than five errors."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.tokens, self.errors = clock, 0, deque(maxlen=1000)

    def used(self, n: int) -> None:
        self.tokens += n

    def failed(self, kind: str) -> None:
        self.errors.append((self.clock(), kind))

    def health(self) -> str:
        return "degraded" if sum(self.clock() - t < 3600 for t, _ in self.errors) > 5 else "ok"


def with_retries(call: Callable[[], object], retryable: Callable[[Exception], bool], fallback: Callable[[], object] | None = None, times: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """A call tried again with growing waits, then its fallback."""
    for k in range(times):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if not retryable(e):
                raise
            if k + 1 == times:
                if fallback is None:
                    raise
                return fallback()
            sleep(wait * 2**k)
    raise AssertionError


def refined(draft: str, pieces: Callable[[], Iterator[str]]) -> str:
    """A refined answer, or the draft when refining fails or says nothing: no answer is lost."""
    try:
        text = "".join(pieces())
    except Exception:  # noqa: BLE001
        return draft
    return text if text.strip() else draft


def events(question: str, run: Callable[[str], object], cache: ResponseCache, limit: RateLimit, usage: Usage, caller: str = "local") -> Iterator[dict]:
    """The events of one answer: status, sql, results, chart, done; or error. Cached answers are told again."""
    if not question.strip():
        yield {"type": "error", "content": "empty question"}
        return
    if not limit.allow(caller):
        yield {"type": "error", "content": "too many questions, try again in a minute"}
        return
    if (old := cache.get(question)) is not None:
        yield from old
        return
    told = [{"type": "status", "content": "running"}]
    yield told[0]
    try:
        r = run(question)
    except Exception as e:  # noqa: BLE001
        usage.failed(type(e).__name__)
        yield {"type": "error", "content": str(e).splitlines()[0]}
        return
    for e in ({"type": "sql", "content": r.sql}, {"type": "results", "content": r.text, "row_count": r.n_rows}, {"type": "chart", "content": r.chart} if r.chart else None, {"type": "done"}):
        if e:
            told.append(e)
            yield e
    cache.put(question, told)


def warm(questions: list[str], ask: Callable[[str], Iterator[dict]]) -> dict[str, str]:
    """Asks each question once so that its answer is kept; question -> ``done`` or what went wrong."""
    out = {}
    for q in dict.fromkeys(questions):
        last = {"type": "error", "content": "nothing came"}
        for last in ask(q):
            pass
        out[q] = "done" if last["type"] == "done" else str(last.get("content"))
    return out
