"""Column functions: text, steps, answers and numbers."""
