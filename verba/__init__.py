"""verba: text labelling as Spark DataFrame / SQL / Structured Streaming jobs."""


def _pickle_udfs_by_value() -> None:
    # Python UDF bodies (NFKD, the plug-in scorer) travel to executors inside the task,
    # so executors need no copy of this package on their import path.
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: ship the package with --py-files
        pass


_pickle_udfs_by_value()
