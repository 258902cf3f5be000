"""Column-level building blocks: names, formats, geometry."""
