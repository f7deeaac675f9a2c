"""Document and evidence analytics as Spark DataFrame transformations."""
