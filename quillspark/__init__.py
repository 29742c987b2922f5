"""Document analytics on PySpark: scans, cleaning, Markdown, LaTeX and exam papers as DataFrames."""
