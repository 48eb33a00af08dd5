"""Tessella: dataset-level operators on Spark for evidence, permit and training-data pipelines."""
