"""Part of minekit; see the README for the map of modules."""
