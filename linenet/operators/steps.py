"""Steps of a data pipeline: what each got and gave, retries, conditions, and a run of several on the driver. Only names
and counts pass between steps; data stay in tables."""

from __future__ import annotations

import hashlib
import time
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Result:
    status: str  # done, skipped or failed
    output: Any = None
    messages: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.status != "failed"


@dataclass
class Context:
    config: dict = field(default_factory=dict)
    results: dict[str, Result] = field(default_factory=dict)
    dry_run: bool = False


@dataclass
class Step:
    """run: (context, input) -> output. check: messages that forbid to run on an input. skip: whether there is nothing to do."""

    name: str
    run: Callable[[Context, Any], Any]
    check: Callable[[Any], list[str]] = lambda _: []
    skip: Callable[[Context, Any], bool] = lambda *_: False
    attempts: int = 1
    delay: float = 1.0
    multiplier: float = 2.0

    def execute(self, context: Context, given: Any, wait: Callable[[float], None] = time.sleep) -> Result:
        wrong = self.check(given)
        if wrong:
            return Result("failed", None, wrong)
        if self.skip(context, given):
            return Result("skipped", given)
        delay, said = self.delay, []
        for attempt in range(1, self.attempts + 1):
            try:
                return Result("done", self.run(context, given), said)
            except Exception as e:  # a step's failure is its result
                said.append(f"attempt {attempt}: {e}")
                if attempt < self.attempts:
                    wait(delay)
                    delay *= self.multiplier
        return Result("failed", None, said)


def run_all(steps: list[Step], context: Context, given: Any = None, ends_if_skipped: tuple[str, ...] = (), wait: Callable[[float], None] = time.sleep) -> Result:
    """Each step gets what the one before gave; a failure ends the run, and so does skipping one of `ends_if_skipped`."""
    result = Result("done", given)
    for step in steps:
        result = context.results[step.name] = step.execute(context, result.output, wait)
        if not result.ok or (result.status == "skipped" and step.name in ends_if_skipped):
            break
    return result


def is_fresh(age_days: float | None, most: float = 7.0) -> bool:
    return age_days is not None and age_days < most


def content_hash(chunks) -> str:
    h = hashlib.sha256()
    for chunk in chunks:
        h.update(chunk)
    return h.hexdigest()


def release(artifacts: dict[str, str], before: dict[str, str], date: str, taken: set[str]) -> str | None:
    """The version of a new release (the date, with a number if it is taken), or None if no content hash changed."""
    if artifacts == before:
        return None
    version, k = f"v{date}", 1
    while version in taken:
        k += 1
        version = f"v{date}.{k}"
    return version


def outdated(versions: list[str], keep: int) -> list[str]:
    """What to delete, so that the latest `keep` stay."""
    return sorted(versions, reverse=True)[keep:]


def load_config(text: str, tiers: tuple[str, ...] = ("required", "optional")) -> dict:
    """A TOML document of mappings: section -> field -> {tag, values, tier}; the tier is named by the section's own table."""
    out: dict[str, dict] = {}
    for section, tables in tomllib.loads(text).items():
        for tier in tiers:
            for name, entry in (tables.get(tier, {}) if isinstance(tables, dict) else {}).items():
                entry = {"tag": entry} if isinstance(entry, str) else dict(entry)
                out.setdefault(section, {})[name] = {**entry, "tier": tier}
    return out
