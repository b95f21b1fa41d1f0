"""gridspan: spreadsheet-style analytics as PySpark DataFrame plans."""
