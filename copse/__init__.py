"""Source-tree and text-corpus analytics as Spark DataFrame plans."""
