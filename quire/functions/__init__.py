"""Part of the layout library."""
