"""Models that are built from a log in steps, some from others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    """``build`` gets the log and the models it needs, by name; ``finish`` what was built, once all is there."""

    name: str
    build: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows


def in_order(models: list[Model]) -> list[Model]:
    """Each model after those it needs; fails if that can't be."""
    left, out, done = list(models), [], set()
    while left:
        ready = [m for m in left if set(m.needs) <= done]
        if not ready:
            raise ValueError(f"models need one another or something that isn't there: {sorted(m.name for m in left)}")
        out += ready
        done |= {m.name for m in ready}
        left = [m for m in left if m.name not in done]
    return out


def built(log: DataFrame, models: list[Model]) -> dict[str, DataFrame]:
    made: dict[str, DataFrame] = {}
    for m in in_order(models):
        made[m.name] = m.build(log, {k: made[k] for k in m.needs})
    finish = {m.name: m.finish for m in models}
    return {k: finish[k](rows) for k, rows in made.items()}
