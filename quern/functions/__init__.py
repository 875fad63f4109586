"""Text functions: Column expressions for documents, and the same rules in Python for queries."""
