"""docflow: document, code and scan-event analytics on PySpark DataFrames."""
