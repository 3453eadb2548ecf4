"""Queries by name, with the SQL that a second engine answers them with."""
