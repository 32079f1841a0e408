"""Evidence-carrying record matching on Spark."""
