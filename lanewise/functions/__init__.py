"""Column -> Column functions: element-wise vectors, capability levels, benchmark arithmetic, names and labels."""
