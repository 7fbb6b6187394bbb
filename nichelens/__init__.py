"""Market and news analytics as DataFrame-to-DataFrame functions on Spark."""
