"""Plans: the modelled workloads expressed on the driver's tables, plus the query registry."""
