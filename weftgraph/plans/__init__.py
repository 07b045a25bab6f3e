"""Query text to syntax trees to DataFrames."""
