"""Shipped configuration; see geochunk.config."""
