"""Operators for preparing language-model training corpora.

Self-contained: nothing outside this folder (and the pipeline module at the
repository top) imports it.
"""
