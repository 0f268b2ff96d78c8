"""Batch jobs on Spark for research on trade ticks: bars, events, labels, weights, features, folds and bet sizes."""
