"""Part of the cutroom library."""
