"""Operators for preparing training data; nothing else in the library imports this package.

Functions of this package travel to executors by value, so a cluster needs no
installed copy of it.
"""

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of a module of this package with their code."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
