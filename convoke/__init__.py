"""Part of convoke."""
