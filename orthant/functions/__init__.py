"""Column functions over vectors and graders over label pairs."""
