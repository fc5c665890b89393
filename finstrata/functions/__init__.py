"""Column builders and small plan fragments shared by the operators."""
