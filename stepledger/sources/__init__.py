"""Datasets, program corpora and result sinks."""
