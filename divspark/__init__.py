"""divspark: run-keyed text-augmentation analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` that takes the run-key
columns (``keys``) and column names as arguments, so any number of experiment
runs (dataset, model, iteration, method) go through one Spark job.
"""

from divspark.session import get_session, checkpoint_dir, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]


def _ship_by_value() -> None:
    """Pickle this package's functions by value for Python workers (mapInPandas,
    applyInPandas), so executors need no installed copy of the package."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
