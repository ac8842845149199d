"""Column expressions: everything here maps Column to Column and stays inside the JVM."""
