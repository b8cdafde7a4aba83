"""A PySpark engine that finds intertextual references in large corpora."""
