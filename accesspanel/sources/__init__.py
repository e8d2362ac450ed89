"""Text sources, declared contracts, layered tables, exports."""
