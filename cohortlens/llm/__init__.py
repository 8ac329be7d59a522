"""Training-data operators over ``documents``-like tables; nothing else in the library imports this package."""
