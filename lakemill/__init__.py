"""Set-based analytics jobs on Spark: load, repair, query and change relational tables."""
