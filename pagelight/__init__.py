"""Document accessibility analytics as Spark DataFrame operators."""
