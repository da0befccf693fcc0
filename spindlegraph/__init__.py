"""A knowledge-graph analytics engine on PySpark DataFrames."""
