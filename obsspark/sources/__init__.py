"""Table and file readers."""
