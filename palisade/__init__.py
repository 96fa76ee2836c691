"""Privacy analytics over screens, pages and text on Apache Spark."""
