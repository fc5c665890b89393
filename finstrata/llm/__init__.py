"""Operators of a training-data pipeline: token files, near duplicates, packing, scans, filters, decontamination, sharding.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
