"""plumbline: ingestion-evidence analytics as Spark plans.

Every public operator takes and returns DataFrames, validates its configuration on the
driver before any job starts, and reports defects of the data as rows, never as exceptions.
"""

__version__ = "0.1.0"
