"""Reading and writing records: JSON lines with aliases, predictions, metrics, summaries."""
