"""Index build, search and evaluation."""
