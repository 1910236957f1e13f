"""Scoring of code graphs against a ground truth, as Spark DataFrame plans."""
