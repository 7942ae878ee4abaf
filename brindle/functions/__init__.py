"""See the package docstring of brindle."""
