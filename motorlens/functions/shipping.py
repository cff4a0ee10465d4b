"""Send a kernel module's functions to executors by value, so they need not have the package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
