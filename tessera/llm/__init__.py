"""Training-data operators. Nothing else in the library imports this subpackage.

Task-side functions are sent to executors by value, so that a worker needs no copy of this
package on its path.
"""

from pyspark import cloudpickle as _cp

from tessera.llm import kernels as _kernels

_cp.register_pickle_by_value(_kernels)


def by_value(name: str) -> None:
    """Called at the end of each operator module: its task-side functions travel by value."""
    import sys

    _cp.register_pickle_by_value(sys.modules[name])
