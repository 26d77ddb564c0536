"""Files and services as Spark data sources."""
