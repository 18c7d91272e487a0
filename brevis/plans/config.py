"""Run configuration: INI sections as frozen objects, values cast by what they
read as, and the presets' operators by name."""

from __future__ import annotations

import configparser
import re
from collections.abc import Callable
from dataclasses import dataclass, field


def basic(text: str) -> int | float | bool | str:
    """A text as integer, float or boolean where it reads as one, else without the
    quotes at its ends, which keep white space that belongs to it."""
    t = text.strip()
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", t):
        return float(t)
    return t in ("True", "true") if t in ("True", "true", "False", "false") else text.strip("\"'")


@dataclass(frozen=True)
class Section:
    """Attributes of one section; one that isn't there is None."""

    values: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self.values.get(name)


@dataclass(frozen=True)
class Config:
    sections: dict[str, Section]

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self.sections.get(name)

    def stage(self, n: int) -> Section | None:
        return self.sections.get(f"stage{n}")


def parse_config(text: str) -> Config:
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read_string(text)
    return Config({name: Section({k: basic(v) for k, v in parser[name].items()}) for name in parser.sections()})


OPERATORS: dict[str, Callable] = {}


def operator(name: str):
    """Register an operator, so that a configuration can name it."""

    def register(f: Callable) -> Callable:
        OPERATORS[name] = f
        return f

    return register


def load_bricks(config: Config, run: str) -> dict[str, Callable]:
    """The operators that section ``{run}.BRICKS`` names, by role."""
    section = config.sections.get(f"{run}.BRICKS")
    if section is None:
        raise KeyError(f"{run}.BRICKS")
    missing = [v for v in section.values.values() if v not in OPERATORS and isinstance(v, str)]
    if missing:
        raise KeyError(f"unknown operators: {', '.join(missing)}")
    return {role: OPERATORS[v] for role, v in section.values.items() if isinstance(v, str)}
