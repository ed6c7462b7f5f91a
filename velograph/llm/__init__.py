"""Operators for building training corpora. Nothing else in the package imports this one.

QUERIES and ORACLES are loaded when they are asked for, so that a task has no more than its own operator in memory."""


def __getattr__(name: str):
    if name not in ("QUERIES", "ORACLES"):
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from velograph.llm import registry

    return getattr(registry, name)
