"""Star-schema bitmap analytics expressed as Spark plans."""
