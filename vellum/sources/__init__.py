"""Reading and writing corpora, and turning formats into Markdown."""
