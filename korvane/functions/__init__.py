"""Functions over columns and scalars."""
