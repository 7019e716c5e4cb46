"""How functions reach the tasks."""

import sys

from pyspark import cloudpickle


def by_value(name: str) -> None:
    """Ship the functions and classes of module ``name`` inside the tasks, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
