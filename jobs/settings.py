"""Config files and logged counts of the jobs."""

from __future__ import annotations

import json
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Observation


def load(path: str | Path, shipped: Path) -> dict:
    """The settings of a JSON file, which must have the keys of the shipped one and values of their kinds; numbers are above zero."""
    given, known = json.loads(Path(path).read_text()), json.loads(shipped.read_text())
    if not isinstance(given, dict) or set(given) != set(known):
        raise ValueError(f"{path} must have the settings {', '.join(sorted(known))}")
    for name, value in given.items():
        number = isinstance(known[name], (int, float))
        if number and (isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0 or isinstance(known[name], int) and value != int(value)):
            raise ValueError(f"{name} in {path} must be {'a whole number' if isinstance(known[name], int) else 'a number'} above zero")
        if not number and not isinstance(value, str):
            raise ValueError(f"{name} in {path} must be a string")
    return given


def counted(observation: Observation, name: str = "rows") -> int:
    """A count to be logged. Where Spark finds while it runs that there is no row, it drops the observation with the rest of the plan: that is 0."""
    try:
        return observation.get[name]
    except Py4JError:
        return 0
