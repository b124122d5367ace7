"""Results of small searches, kept on the driver under the version of what they were made from."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict


class ResultCache:
    """Least recently used entries go first; entries older than ``ttl`` seconds are gone.

    A key holds the collection's version, so a write makes older results unreachable.
    """

    def __init__(self, entries: int = 1000, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        if entries < 1 or ttl <= 0:
            raise ValueError("entries and ttl must be positive")
        self.most, self.ttl, self.clock = entries, ttl, clock
        self._held: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = self.evictions = 0
        self.searches, self.latency = 0, 0.0

    @staticmethod
    def key(version, request) -> str:
        body = asdict(request)
        body.pop("params", None)
        return hashlib.sha256(json.dumps([version, body], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str):
        held = self._held.get(key)
        if held is None or self.clock() - held[0] > self.ttl:
            self._held.pop(key, None)
            self.misses += 1
            return None
        self._held.move_to_end(key)
        self.hits += 1
        return held[1]

    def put(self, key: str, value) -> None:
        self._held[key] = (self.clock(), value)
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
            self.evictions += 1

    def through(self, version, request, run: Callable[[], object]):
        """The value for a request, made by ``run`` if it isn't held."""
        began, key = time.monotonic(), self.key(version, request)
        value = self.get(key)
        if value is None:
            value = run()
            self.put(key, value)
        self.searches += 1
        taken = time.monotonic() - began
        self.latency = taken if self.searches == 1 else 0.9 * self.latency + 0.1 * taken
        return value

    def sweep(self) -> int:
        """Drop what is too old; returns its number."""
        old = [k for k, (t, _) in self._held.items() if self.clock() - t > self.ttl]
        for k in old:
            del self._held[k]
        return len(old)

    def clear(self) -> None:
        self.evictions += len(self._held)
        self._held.clear()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "entries": len(self._held), "hit_rate": self.hits / asked if asked else 0.0, "evictions": self.evictions, "searches": self.searches, "latency": self.latency}
