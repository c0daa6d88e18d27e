"""Grid recipes over tables and the registry of queries."""
