"""Motor-current diagnostics as Spark DataFrame operators."""
