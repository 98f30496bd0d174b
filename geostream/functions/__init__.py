"""Column helpers, composed of built-in functions only."""
