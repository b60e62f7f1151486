"""Building blocks shared by several operators, and the end-to-end jobs."""
