"""Find personal values in text tables and replace them by stable tokens, on Spark."""
