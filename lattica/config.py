"""Settings of the library."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

_settings = {"ndarray_multiplication": True}


def get_ndarray_multiplication() -> bool:
    return _settings["ndarray_multiplication"]


def set_ndarray_multiplication(on: bool) -> None:
    """Whether an operator times an array applies it (the default) or is refused, so that only matvec and frames do."""
    _settings["ndarray_multiplication"] = bool(on)


@contextmanager
def disabled_ndarray_multiplication() -> Iterator[None]:
    """Refuses products of operators and arrays inside the block."""
    was = get_ndarray_multiplication()
    set_ndarray_multiplication(False)
    try:
        yield
    finally:
        set_ndarray_multiplication(was)
