"""Nested domains: order of runs."""

from __future__ import annotations


def run_order(parents: dict[str, str | None]) -> list[tuple[int, str]]:
    """(level, name), parents before children, names in order within a level; an unknown parent or a cycle is an error."""
    for name, parent in parents.items():
        if parent is not None and parent not in parents:
            raise ValueError(f"domain {name!r} has an unknown parent {parent!r}")
    level: dict[str, int] = {}
    for name in parents:
        chain, at = [], name
        while at is not None and at not in level:
            if at in chain:
                raise ValueError(f"domains {chain} are a cycle")
            chain.append(at)
            at = parents[at]
        base = -1 if at is None else level[at]
        for k, x in enumerate(reversed(chain)):
            level[x] = base + 1 + k
    return sorted((depth, name) for name, depth in level.items())
