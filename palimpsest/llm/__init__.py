"""Training-data operators on Spark DataFrames.

Every operator takes DataFrames and column names and returns a DataFrame; none of
them is imported by the rest of the library.
"""
