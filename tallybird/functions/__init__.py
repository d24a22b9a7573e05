"""Column and small-aggregate building blocks shared by the operators."""
