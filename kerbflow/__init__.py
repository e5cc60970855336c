"""Street stress and transit reliability as Spark DataFrame operators."""
