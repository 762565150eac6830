"""Parameters of a job, given on the command line, and the metrics it leaves."""

from __future__ import annotations

import json
import os

_given: dict[str, str] = {}
_metrics: dict = {}


def set_params(values: dict[str, str]) -> None:
    _given.clear()
    _given.update(values)


def param(key: str, default=None):
    """A parameter of the job: from ``set_params``, the command line, or WEFT_PARAMS as JSON."""
    return _given.get(key, json.loads(os.environ.get("WEFT_PARAMS", "{}")).get(key, default))


class metrics:  # noqa: N801 - read as a module's
    @staticmethod
    def set(key: str, value: str | float | bool | None) -> None:
        if not isinstance(key, str) or not key:
            raise ValueError("a metric is named by text")
        if not isinstance(value, (str, int, float, bool, type(None))):
            raise TypeError("a metric is text, a number, a truth value or None")
        _metrics[key] = value

    @staticmethod
    def get(key: str):
        return _metrics.get(key)

    @staticmethod
    def all() -> dict:
        return dict(_metrics)
