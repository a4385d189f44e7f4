"""A PySpark engine for metrical text, timelines and corpora."""
