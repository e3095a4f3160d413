"""foliospark: document analytics as Spark DataFrame operators."""
