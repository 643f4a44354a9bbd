"""promptforge — text-to-image prompt optimisation data work as Spark DataFrame plans.

Sub-packages:

* ``functions``  – Column-level expressions (text normalisation, reply parsing).
* ``sources``    – readers and writers for the file formats the pipeline exchanges.
* ``operators``  – DataFrame -> DataFrame operators (scores, selection, history,
  merge, sampling, requests, replies, training text).
* ``plans``      – composed jobs, fixture views over the driver tables and the
  query registry used by ``__spark_entry__``.
* ``streaming``  – incremental ingestion of reply files with Structured Streaming.
"""

from promptforge.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
