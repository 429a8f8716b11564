"""Reading and auditing delimited text, and table-level gates."""
