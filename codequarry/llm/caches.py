"""Caches that live as long as a worker process: an operator that starts in a process drops those of the others."""

from __future__ import annotations


class Local(dict):
    """What one process holds: it does not travel with the functions that use it."""

    def __reduce__(self):
        return dict, ()


_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """The cache of an operator in this process."""
    return _CACHES.setdefault(owner, Local())


def claim(owner: str) -> None:
    """Tasks of ``owner`` run in this process now: workers are reused, and memory that other operators hold is given back."""
    for other, held in _CACHES.items():
        if other != owner:
            held.clear()
