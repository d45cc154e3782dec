"""Reading and writing tables, worksheets and pages."""
