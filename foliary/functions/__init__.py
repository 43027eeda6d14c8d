"""Part of foliary; see the README."""
