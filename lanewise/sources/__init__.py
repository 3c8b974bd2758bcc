"""Generated inputs, result files, and hardware descriptions as tables."""
