"""Column functions and model providers."""
