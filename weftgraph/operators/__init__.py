"""Graph, text and vector operators over DataFrames."""
