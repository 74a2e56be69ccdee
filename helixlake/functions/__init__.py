"""Spark-first pangenome and metagenome analytics."""
