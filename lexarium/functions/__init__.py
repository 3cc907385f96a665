"""See the package docstring in lexarium/__init__.py."""
