"""Column functions: text and number checks, identifiers, dates and display forms."""
