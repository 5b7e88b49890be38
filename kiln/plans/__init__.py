"""Registered query plans: each reads the fixture tables (or data Spark
derives from them) and has a DuckDB oracle where SQL can express it."""
