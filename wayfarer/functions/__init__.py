"""Part of wayfarer."""
