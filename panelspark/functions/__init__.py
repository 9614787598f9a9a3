"""Part of panelspark."""
