"""Wake-ups for readers that wait at the head of a log."""

from __future__ import annotations

import threading


class Notifier:
    """In memory. Each registration is for one wake-up."""

    def __init__(self):
        self._lock, self._waiting = threading.Lock(), []

    def register(self) -> threading.Event:
        event = threading.Event()
        with self._lock:
            self._waiting.append(event)
        return event

    def notify(self) -> None:
        with self._lock:
            waiting, self._waiting = self._waiting, []
        for event in waiting:
            event.set()
