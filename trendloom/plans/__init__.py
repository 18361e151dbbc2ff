"""Registered queries over the TPC-H-like tables, each with its SQL twin where one exists."""
