"""Part of geochunk; see README.md."""
