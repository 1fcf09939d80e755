"""Order-intelligence engine on PySpark: sources, text functions, linkage, extraction, evaluation, streaming."""
