"""Learning-platform analytics as plain PySpark DataFrame programs."""
