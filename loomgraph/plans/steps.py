"""Pipelines as step registries: names, functions and what they need; a run is a slice of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Steps:
    steps: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, needs: tuple[str, ...] = ()) -> Callable:
        def put(f: Callable) -> Callable:
            missing = [n for n in needs if n not in self.steps]
            if missing:
                raise ValueError(f"{name} needs unknown steps {missing}")
            self.steps[name] = (f, needs)
            return f

        return put

    def chosen(self, only: list[str] | None = None, start: str | None = None, end: str | None = None, skip: tuple[str, ...] = (), flags: dict[str, bool] | None = None, optional: dict[str, str] | None = None) -> list[str]:
        """Names in order: `only` these, or from start to end, without those skipped or whose flag is off."""
        names = list(self.steps)
        if only and (start or end):
            raise ValueError("choose steps or a range, not both")
        for n in [*(only or []), *filter(None, (start, end)), *skip]:
            if n not in self.steps:
                raise ValueError(f"no step {n}")
        lo, hi = names.index(start) if start else 0, names.index(end) if end else len(names) - 1
        picked = [n for n in names if n in only] if only else names[lo : hi + 1]
        off = {n for n, flag in (optional or {}).items() if not (flags or {}).get(flag)}
        return [n for n in picked if n not in skip and n not in off]

    def run(self, names: list[str], *args, done: dict | None = None) -> dict:
        """Results by name; a step gets those of the steps it needs, from this run or an earlier one."""
        results = dict(done or {})
        for n in names:
            f, needs = self.steps[n]
            absent = [x for x in needs if x not in results]
            if absent:
                raise ValueError(f"{n} needs {absent} first")
            results[n] = f(*args, **{x: results[x] for x in needs})
        return results
