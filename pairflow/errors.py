"""What can go wrong, as exceptions."""


class PairflowError(Exception):
    """Base of all errors of the engine. Errors of this kind are never retried."""


class InvalidAction(PairflowError):
    """A step has an action that no operator implements."""


class InvalidStep(PairflowError):
    """A step does not exist or its options make no sense."""


class InvalidJob(PairflowError):
    """A job's name or class is not registered."""


class JobStopped(PairflowError):
    """A run was stopped before its end."""


class IncompatibleFrame(PairflowError):
    """Two datasets have different numbers of partitions."""


class InvalidChunkLimit(PairflowError):
    """A merge fan-in below two."""


class InvalidKey(PairflowError):
    """A key's type has no order, or several types are mixed."""


class DuplicateKey(PairflowError):
    """The right side of a combine has a key more than once."""
