"""dialoom: build, convert, parse and score tool-calling dialogue data as Spark jobs."""
