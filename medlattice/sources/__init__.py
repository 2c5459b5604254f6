"""Part of medlattice: sources."""
