"""Operators of a training-data pipeline over ``documents``, ``pages``,
``benchmark`` and ``labels``.  Nothing outside this subpackage imports it
except ``__spark_entry__.py`` and ``corpus_pipeline.py``."""
