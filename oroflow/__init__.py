"""oroflow: terrain, drainage and geo-feature analytics as Spark DataFrames."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile


def ship(spark) -> str:
    """Send the package to the executors of a cluster where it is not installed; the archive's path. Once a session."""
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("oroflow", os.path.relpath(path, here)))
    at = os.path.join(tempfile.mkdtemp(prefix="oroflow-"), "oroflow.zip")
    with open(at, "wb") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(at)
    return at
