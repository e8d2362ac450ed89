"""Table builders and analytical questions composed from the operators."""
