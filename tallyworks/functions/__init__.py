"""Column functions: safe arithmetic and the classification ladders."""
