"""The llm of the library."""
