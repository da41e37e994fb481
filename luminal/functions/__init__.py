"""Column functions: everything here takes and gives Spark columns, and stays inside Catalyst."""
