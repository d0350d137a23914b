"""Source tables: declared schemas, loading by name, calendar."""
