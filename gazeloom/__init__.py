"""PySpark operators for keyed, ordered measurement series."""
