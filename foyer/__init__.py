"""A PySpark engine for multi-source property listings."""
