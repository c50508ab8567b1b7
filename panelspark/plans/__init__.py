"""Plan helpers: lineage cuts, size checks and the shared folder."""
