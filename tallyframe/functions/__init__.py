"""Column functions: lenient casts, labels, text previews."""
