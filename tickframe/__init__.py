"""Market-data analytics and corpus operators on Spark."""
