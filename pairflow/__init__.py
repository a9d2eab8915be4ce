"""A Spark-first engine for keyed map/reduce analytics."""

import sys

from pyspark import cloudpickle

from .errors import DuplicateKey, IncompatibleFrame, InvalidAction, InvalidChunkLimit, InvalidJob, InvalidKey, InvalidStep, JobStopped, PairflowError
from .functions.partitioning import hash_partitioner, identity_partitioner
from .plans.config import configure, get_config
from .plans.job import Job
from .plans.nodes import ALL_ACTIONS, Action
from .plans.resolver import resolve_jobs
from .plans.runner import Runner
from .sources.store import HadoopStore, MemoryStore, Store

__all__ = [
    "ALL_ACTIONS", "Action", "DuplicateKey", "HadoopStore", "IncompatibleFrame", "InvalidAction", "InvalidChunkLimit", "InvalidJob", "InvalidKey", "InvalidStep", "Job", "JobStopped", "MemoryStore",
    "PairflowError", "Runner", "Store", "configure", "get_config", "hash_partitioner", "identity_partitioner", "resolve_jobs",
]

# Functions of this package travel to the executors by value, so that the
# package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
