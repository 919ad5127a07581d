"""Reading and writing tables, text corpora, result maps and run stores."""
