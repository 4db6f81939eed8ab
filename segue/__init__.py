"""Sequence-completion analytics on Spark: corpora of ordered lists, recommenders, and their evaluation."""
