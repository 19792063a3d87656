"""Queries of the driver's contract and the SQL they are checked against."""
