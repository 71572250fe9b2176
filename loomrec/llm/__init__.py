"""Training-data operators; nothing else in loomrec imports this subpackage."""
