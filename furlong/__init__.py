"""furlong: race-event analytics as PySpark jobs."""
