"""loomrec.plans."""
