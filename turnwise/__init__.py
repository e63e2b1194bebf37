"""turnwise: retrieval analytics over long multi-session conversations, on PySpark.

Every operator is a function from DataFrames to a DataFrame. Keys are explicit
columns, nothing is paired by position, and nothing that grows with the data
passes through the driver.
"""
