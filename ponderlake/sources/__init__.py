"""Reading records (JSON Lines, documents, metric logs, configuration) and writing results and reports."""
