"""Ship pandas-UDF helpers to Python workers by value.

Functions given to ``applyInPandas`` / ``mapInPandas`` are pickled; module-level
functions are normally pickled by reference, so every worker would have to
import this package. Registering the module for pickling by value sends the
code itself, so executors need nothing installed beyond PySpark, numpy and pandas.
"""

from __future__ import annotations

import sys


def by_value(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
        pass
