"""Column helpers: ``Column -> Column`` functions built from Spark's own."""
