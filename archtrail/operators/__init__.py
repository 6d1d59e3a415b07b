"""Graph and activity operators over DataFrames."""
