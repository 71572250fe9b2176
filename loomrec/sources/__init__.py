"""loomrec.sources."""
