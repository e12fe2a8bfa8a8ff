"""Column functions: text, deterministic choice, image and frame arithmetic."""
