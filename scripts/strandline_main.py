"""What spark-submit starts: the package beside this folder."""

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandline.__main__ import run  # noqa: E402

shown = run(SparkSession.builder.appName("strandline").getOrCreate(), sys.argv[1:])
if shown is not None:
    shown.show(1000, truncate=False)
