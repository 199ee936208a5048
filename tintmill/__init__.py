"""Value provenance over transaction graphs, as Spark plans."""
