"""Evidence analytics and training-data preparation, expressed as Spark plans."""
