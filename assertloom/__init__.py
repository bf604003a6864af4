"""Assertloom: corpora of hardware temporal assertions, built and analysed on Spark."""

__version__ = "0.1.0"
