"""wayfarer: Spark jobs for randomized robot-navigation trials."""
