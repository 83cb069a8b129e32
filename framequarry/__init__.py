"""framequarry: bus-telemetry analytics expressed as Spark DataFrame plans."""

from __future__ import annotations


def ship(spark) -> None:
    """Sends this package to the executors of a cluster where it isn't installed, so that Python workers can import it by name."""
    import os
    import shutil
    import tempfile

    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "framequarry"), "zip", os.path.dirname(root), "framequarry"))
