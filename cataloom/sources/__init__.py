"""Sources: parsers of raw records, literal seeds, and readers of the services."""
