"""Knowledge-graph and retrieval analytics as Spark DataFrame operators."""
