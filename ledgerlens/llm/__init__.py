"""Operators of a training-data pipeline over ``documents`` and ``pages``: quality, duplicates,
language models, tokens, contamination, licences, personal data, archives and packing.

Nothing else in the library imports this subpackage.
"""
