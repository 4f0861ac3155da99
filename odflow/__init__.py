"""Origin/destination flow analytics as PySpark DataFrame transformations.

Every public function takes and returns DataFrames or Columns; nothing here
collects rows to the driver and no Python code runs per row.
"""
