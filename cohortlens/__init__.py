"""cohortlens: build cohort feature tables from activity logs and judge
synthetic copies of them, as Spark jobs.

Sub-packages
------------
sources    readers and writers (parquet tables, CSV exports, result JSON)
functions  column expressions (hash draws, safe ratios, labels)
operators  relational building blocks (splits, distributions, metrics, models)
plans      composed jobs (student tables, evaluation runs, roll-ups)
streaming  incremental click-log aggregation
"""

__version__ = "0.1.0"
