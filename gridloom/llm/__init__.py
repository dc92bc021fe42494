"""Operators of a training-data pipeline.  Nothing else in gridloom imports this subpackage."""
