"""Part of skyquarry."""
