"""Relation extraction, evaluation and similarity classification on Spark DataFrames."""
