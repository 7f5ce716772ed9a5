"""hirelake: talent analytics as Spark DataFrame operators."""
