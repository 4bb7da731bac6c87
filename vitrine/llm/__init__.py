"""Operators of a training-data pipeline: packing, deduplication, search, classification, rules, mixing and scans."""
