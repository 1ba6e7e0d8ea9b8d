"""Track-reconstruction analytics as Spark jobs, keyed by (run, event)."""
