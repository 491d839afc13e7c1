"""A small runner for the daily tasks: dependencies, summaries, post-conditions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    """``run(results)`` gives a summary; ``check(summary)`` gives a list of what is wrong with it."""

    name: str
    run: Callable[[dict], dict]
    needs: tuple[str, ...] = ()
    check: Callable[[dict], list[str]] = field(default=lambda summary: [])


def ordered(tasks: list[Task]) -> list[Task]:
    """Tasks after all they need; an unknown need or a cycle raises."""
    names, done, out = {t.name for t in tasks}, set(), []
    for task in tasks:
        if lost := set(task.needs) - names:
            raise ValueError(f"{task.name} needs {', '.join(sorted(lost))}, which is no task")
    while len(out) < len(tasks):
        ready = [t for t in tasks if t.name not in done and done.issuperset(t.needs)]
        if not ready:
            raise ValueError("the tasks need each other in a circle")
        out += ready
        done |= {t.name for t in ready}
    return out


def at_least(path: str, least: float) -> Callable[[dict], list[str]]:
    """A check that a value, named by a dotted path, is a number and not below a bound. A missing value is a failure."""

    def check(summary: dict) -> list[str]:
        value = summary
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return [f"{path} is {value!r}, no number"]
        return [] if value >= least else [f"{path} is {value}, below {least}"]

    return check


def both(*checks: Callable[[dict], list[str]]) -> Callable[[dict], list[str]]:
    return lambda summary: [x for c in checks for x in c(summary)]


def equals(path: str, wanted: float) -> Callable[[dict], list[str]]:
    exists = at_least(path, float("-inf"))

    def check(summary: dict) -> list[str]:
        if wrong := exists(summary):
            return wrong
        value = summary
        for key in path.split("."):
            value = value[key]
        return [] if value == wanted else [f"{path} is {value}, not {wanted}"]

    return check


def run(tasks: list[Task]) -> dict[str, dict]:
    """Run all tasks in order; the first summary with a fault stops the run. Summaries are plain JSON."""
    results: dict[str, dict] = {}
    for task in ordered(tasks):
        summary = json.loads(json.dumps(task.run(results)))
        if wrong := task.check(summary):
            raise RuntimeError(f"{task.name}: {'; '.join(wrong)}")
        results[task.name] = summary
    return results


def evaluate(outputs: dict[str, object], checks: dict[str, Callable[[dict], list[str]]]) -> list[str]:
    """Faults of finished tasks' summaries (text or objects); a missing task or malformed summary is one."""
    faults = []
    for name, check in checks.items():
        if name not in outputs:
            faults.append(f"{name}: no summary")
            continue
        summary = outputs[name]
        try:
            summary = json.loads(summary) if isinstance(summary, str) else summary
        except ValueError:
            summary = None
        faults += [f"{name}: {x}" for x in check(summary)] if isinstance(summary, dict) else [f"{name}: the summary is no object"]
    return faults


#: Post-conditions of every daily task.
DAILY_CHECKS = {
    "ingest": both(at_least("feed.rows", 1), at_least("weather.rows", 1)),
    "bronze": at_least("rows", 1),
    "silver": both(at_least("electricity_hourly", 1), at_least("weather_forecast_hourly", 1), at_least("electricity_quarantine", 0)),
    "gold": at_least("daily_summary", 1),
    "features": both(at_least("rows", 1), at_least("labelled", 1)),
    "leakage_audit": both(at_least("pairs", 1), equals("violations", 0), at_least("known_leaky_caught", 1)),
    "forecast": at_least("predictions", 1),
    "accuracy": at_least("rows", 1),
}
