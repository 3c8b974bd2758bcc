"""The kernels over streams."""
