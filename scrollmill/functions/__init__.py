"""Part of scrollmill."""
