"""Operators of training-data pipelines over text, web pages and URLs."""
