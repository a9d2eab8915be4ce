"""The engine's configuration and the registry of job classes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidJob, PairflowError


@dataclass(frozen=True)
class Config:
    """``store`` is for the application's own objects; ``enqueuer`` names a scheduler pool; ``show_progress`` tells whether Spark's progress bar is wanted."""

    store: Any = None
    enqueuer: str | None = None
    show_progress: bool = True
    jobs: dict[str, type] = field(default_factory=dict)

    def name_of(self, job_class: type) -> str:
        for name, known in self.jobs.items():
            if known is job_class:
                return name
        raise InvalidJob(f"{job_class.__name__} is not registered")

    def class_of(self, name: str) -> type:
        if name not in self.jobs:
            raise InvalidJob(name)
        return self.jobs[name]


_current: Config | None = None


def configure(**options) -> Config:
    """Sets the whole configuration; what is not given gets its default."""
    global _current
    jobs = dict(options.get("jobs") or {})
    if any(not name for name in jobs):
        raise InvalidJob("a job's name is empty")
    if len({id(c) for c in jobs.values()}) < len(jobs):
        raise InvalidJob("a class has two names")
    _current = Config(**(options | {"jobs": jobs}))
    return _current


def get_config() -> Config:
    if _current is None:
        raise PairflowError("the engine is not configured")
    return _current


def reset() -> None:
    global _current
    _current = None
