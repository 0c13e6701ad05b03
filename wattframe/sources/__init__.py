"""Table readers, writers and catalog reports."""
