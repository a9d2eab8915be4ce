"""Which jobs a run has, dependencies first."""

from __future__ import annotations

from collections.abc import Iterable

from .compiler import reachable
from .job import Job
from .nodes import Node


def resolve_jobs(jobs: Job | Iterable[Job]) -> list[Node]:
    """The last nodes of all jobs needed, each once: those that a job depends on before it, else in the order given."""
    out: list[Node] = []
    for job in [jobs] if isinstance(jobs, Job) else jobs:
        if job.node is None:
            continue
        depended = [n.other for n in reachable([job.node]) if n.other is not None]
        out += [n for n in [*depended, job.node] if n not in out]
    return list(dict.fromkeys(out))
