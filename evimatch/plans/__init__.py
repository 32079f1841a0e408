"""Derived views and named queries over the star schema."""
