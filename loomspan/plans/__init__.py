"""Named queries and their SQL, collected by __spark_entry__."""
