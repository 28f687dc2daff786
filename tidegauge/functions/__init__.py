"""Column expressions and distribution tails shared by the operators."""
