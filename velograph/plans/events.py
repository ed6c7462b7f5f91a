"""Named events with callbacks, by which a run hands out its data."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import Any


class Events:
    """Callbacks by event, run in the order in which they were added."""

    def __init__(self):
        self._hooks: dict[str, list[Callable[..., Any]]] = defaultdict(list)

    def on(self, event: str, hook: Callable[..., Any]) -> None:
        self._hooks[event].append(hook)

    def publish(self, event: str, **data: Any) -> list[Any]:
        return [hook(**data) for hook in self._hooks[event]]
