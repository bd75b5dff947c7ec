"""Table and planar-geometry kernels for Spark DataFrames."""
