"""Training-data operators: ten corpus operations that nothing else in the library imports."""
