"""Named stages run in order over named tables.

A stage takes the tables so far and gives those it adds; nothing runs until a
table is written, so a stage whose tables nobody reads costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Tables, Options], Tables]
    can_skip: Callable[[Tables, Options], bool] = lambda tables, options: False


@dataclass(frozen=True)
class Options:
    """What a run is asked for; rendering implies translating, and translating all courses."""

    target_lang: str = "tl"
    translate: bool = False
    render: bool = False
    all_courses: bool = False
    backend: str = "dictionary"
    extra: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, args: list[str]) -> Options:
        named = dict(a[2:].split("=", 1) for a in args if a.startswith("--") and "=" in a)
        render = "--render" in args
        translate = render or "--translate" in args
        return cls(named.get("target-lang", "tl"), translate, render, render or "--all" in args, named.get("translator", "dictionary"))


def truthy(value: str | None, default: bool = False) -> bool:
    """A setting's yes or no: true is yes, nothing is the default, all else is no."""
    return default if not value else value.lower() == "true"


def run_stages(stages: list[Stage], tables: Tables, options: Options, stop_after: str | None = None) -> tuple[Tables, list[str]]:
    """The tables after the last stage and the names of those that ran."""
    if stop_after and stop_after not in [s.name for s in stages]:
        raise ValueError(f"no stage {stop_after!r}")
    done: list[str] = []
    for stage in stages:
        if not stage.can_skip(tables, options):
            tables = tables | stage.run(tables, options)
            done.append(stage.name)
        if stage.name == stop_after:
            break
    return tables, done
