"""Domain pipelines composed of the operators."""
