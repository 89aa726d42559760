"""Time-series anomaly analytics on Spark DataFrames.

Points are rows ``series_id, t, x, y``: an ordered position, a value and a 0/1
label per series. Operators are functions from DataFrames to DataFrames.
"""
