"""fundscope: audit analytics for deposit, withdrawal and loan ledgers on Spark.

Every operator takes and returns DataFrames (or Columns) and is written with
Spark SQL built-ins, so the work runs on executors and Catalyst sees the whole
plan.  Sub-packages:

* ``functions``  Column-level helpers (safe arithmetic, keys, URLs, geo, masks).
* ``operators``  Table operators, data-quality checks, statistics, retrieval.
* ``sources``    Readers, driver-table adapters, incremental sync and upsert.
* ``plans``      Medallion models, audit rules, ML features/training/scoring.
* ``streaming``  Structured Streaming versions of the incremental and rule jobs.
"""

__version__ = "0.1.0"
