"""A bounded cache for what a worker derives from each word."""

from __future__ import annotations


class Cache:
    """Keeps between one and two times ``size`` entries in two generations; the older goes when the younger is full.

    A generation is also full when its keys hold ROOM characters an entry, and a key of more than LONGEST characters is
    never kept, so the bytes are bounded also where texts have no spaces (values grow with their keys). Once the first generation
    has filled, a key enters only when it is seen for the second time (a table of marks, cleared when half full,
    tells), so the many words that occur once do not drive out the others.
    """

    MARKS, ROOM, LONGEST = 1 << 22, 32, 512

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}
        self.held = 0
        self.seen, self.marked = bytearray(self.MARKS), 0

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self._keep(key, got)
        return got

    def put(self, key, value):
        if len(key) > self.LONGEST:
            return value
        if self.old:
            at = hash(key) % self.MARKS
            if not self.seen[at]:
                self.seen[at] = 1
                self.marked += 1
                if self.marked > self.MARKS // 2:
                    self.seen, self.marked = bytearray(self.MARKS), 0
                return value
        self._keep(key, value)
        return value

    def _keep(self, key, value):
        if len(self.young) >= self.size or self.held > self.size * self.ROOM:
            self.old, self.held = dict(self.young), 0
            self.young.clear()  # the dict itself stays: callers may hold its get
        self.young[key] = value
        self.held += len(key)
