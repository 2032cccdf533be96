"""Vacantia: employer-discovery analytics expressed as Spark plans."""
