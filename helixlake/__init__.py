"""Spark-first pangenome and metagenome analytics."""

VERSION = "0.2.0"
