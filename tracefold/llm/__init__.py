"""Operators of a training-data pipeline: tokens, shards, archives, filters, near copies.

Nothing outside this subpackage imports it. The operators keep general interfaces (DataFrame in, DataFrame
out); ``queries`` holds the thin registered jobs.
"""
