"""loomrec: keyed, nested, cross-referencing records as Spark tables."""
