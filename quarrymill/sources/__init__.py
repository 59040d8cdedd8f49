"""Sources of records: delimited lists, landed JSON answers, and their registry."""
