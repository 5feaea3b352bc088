"""Readers of tables, files and streams, and the shapes that operators take derived from them."""
