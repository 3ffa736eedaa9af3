"""A PySpark engine for catalogues of published statistical tables."""
