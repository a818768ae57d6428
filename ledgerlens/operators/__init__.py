"""DataFrame operators: profiling, encoding, imputation, reduction, graphs, models."""
