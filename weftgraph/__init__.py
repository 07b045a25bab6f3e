"""A property-graph analytics engine that compiles graph queries to Spark DataFrames."""
