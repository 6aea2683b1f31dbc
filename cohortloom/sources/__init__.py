"""Table readers, the stand-in views for testing, and result writers."""
