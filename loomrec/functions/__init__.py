"""loomrec.functions."""
