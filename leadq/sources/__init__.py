"""Feed readers and file writers."""
