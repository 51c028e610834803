"""Reading tables, numbering rows and writing the outputs."""
