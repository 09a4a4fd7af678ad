"""Reading and writing of records."""
