"""Command lines: python -m lumenforge.tools <command> ..., by spark-submit or on one machine."""
