"""Holdfast: customer-retention analytics as Spark jobs.

Every public function takes and returns DataFrames.  Nothing is collected on
the way except scalars of proven size (quantile bounds, hot-key lists).
"""
