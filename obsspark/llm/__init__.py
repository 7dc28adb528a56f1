"""Operators of a training-data pipeline; nothing else in the library imports them.

``queries.py`` registers one query per operator, ``corpus_pipeline.py`` at the
repository top chains five of them.
"""
