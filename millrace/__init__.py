"""Record intake on Spark: extract, admit, merge, rank and diff as DataFrame work."""
