"""Named queries over a folder of Parquet tables, and SQL that gives the same results."""
