"""vigil: security-event analytics on Spark."""


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (tree growth,
    scoring, stateful stream functions) are serialised by value, so
    executors do not need the package installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - very old cloudpickle
        pass


_ship_by_value()
