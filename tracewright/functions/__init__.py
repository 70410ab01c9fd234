"""Column functions and lineage helpers that the operators share."""
