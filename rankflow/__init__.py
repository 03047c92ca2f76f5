"""Group-communication analytics as Spark DataFrame jobs.

Every function takes and returns DataFrames (or Columns); Catalyst plans the
work.  See README.md for the map from operation to module.
"""
