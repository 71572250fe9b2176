"""loomrec.streaming."""
