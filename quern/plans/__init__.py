"""The query language: parsed once on the driver, compiled to Column expressions."""
