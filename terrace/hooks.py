"""Hooks around the operations of a plan: Python callables and commands."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from terrace.errors import HookFailed

PHASES = ("before_create", "after_create", "before_attach", "after_attach", "before_detach", "after_detach", "before_drop", "after_drop")


@dataclass
class Hooks:
    """``on_event`` hears of every phase first; an error before an operation stops that operation."""

    on_event: Callable[[dict], None] | None = None
    by_phase: dict[str, list[Callable[[dict], None]]] = field(default_factory=dict)

    def add(self, phase: str, fn: Callable[[dict], None]) -> Hooks:
        if phase not in PHASES:
            raise ValueError(f"unknown phase {phase!r}")
        self.by_phase.setdefault(phase, []).append(fn)
        return self

    def fire(self, phase: str, event: dict) -> None:
        event = {"phase": phase, **event}
        for fn in [*([self.on_event] if self.on_event else []), *self.by_phase.get(phase, [])]:
            try:
                fn(event)
            except Exception as e:
                raise HookFailed(f"{phase}: {e}") from e


def command(argv: list[str], timeout: float = 60.0, env: dict[str, str] | None = None) -> Callable[[dict], None]:
    """A hook that runs a command without a shell and gives it the event as JSON on its input."""

    def run(event: dict) -> None:
        done = subprocess.run(argv, input=json.dumps(event, default=str), text=True, capture_output=True, timeout=timeout, env=env, check=False)
        if done.returncode:
            raise HookFailed(f"{argv[0]} ended with {done.returncode}: {done.stderr.strip()[:300]}")

    return run
