"""Column expressions: keys, JSON envelopes, GTIDs, table names. All run inside the JVM."""
