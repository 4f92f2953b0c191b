"""Training-data operators. Self-contained: nothing outside this package imports it."""
