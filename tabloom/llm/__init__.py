"""Operators of a training-data pipeline over web text."""
