"""Frame, clip, vector, job and request analytics as functions from DataFrames to DataFrames."""
