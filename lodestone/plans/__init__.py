"""Query plans over the driver tables, and the same queries in SQL."""
