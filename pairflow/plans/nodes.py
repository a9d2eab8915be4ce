"""Plan nodes. A node is known by its identity: jobs that share one share its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T

from ..errors import InvalidStep
from ..functions.keys import check_key


class Action(str, Enum):
    PARALLELIZE = "parallelize"
    SCAN = "scan"
    LOAD = "load"
    MAP = "map"
    MAP_PARTITIONS = "map_partitions"
    REDUCE = "reduce"
    COMBINE = "combine"
    APPEND = "append"
    EACH_PARTITION = "each_partition"
    DUMP = "dump"
    DERIVED = "derived"


ALL_ACTIONS = tuple(Action)
#: Steps that run for their effects and hand on their input.
SINKS = (Action.EACH_PARTITION, Action.DUMP)


@dataclass(eq=False, frozen=True)
class Node:
    action: Action
    partitions: int
    partitioner: Any
    parent: Node | None = None
    other: Node | None = None
    block: Callable | str | None = None
    schema: Any = None
    jobs: int | None = None
    enqueuer: str | None = None
    before: Callable | None = None
    options: dict = field(default_factory=dict)

    @property
    def unique(self) -> bool:
        """Whether every key is known to occur once."""
        if self.action in SINKS:
            return self.parent.unique
        if self.options.get("moved"):
            return self.parent.unique
        return self.action == Action.REDUCE or bool(self.options.get("unique"))

    @property
    def inputs(self) -> list[Node]:
        return [x for x in (self.parent, self.other) if x is not None]


def pair_schema(schema: str | T.StructType) -> T.StructType:
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if [f.name for f in out.fields] != ["k", "v"]:
        raise InvalidStep("a schema has the fields k and v")
    check_key(out["k"].dataType)
    return out
