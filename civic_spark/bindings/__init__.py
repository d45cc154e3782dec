"""The civic tables expressed over the driver's generic tables, for queries, tests and benchmarks."""
