"""loomrec.operators."""
