"""DataFrame -> DataFrame operators: kernels over rows and pairs, statistics, verification, ranking, and the registry."""
