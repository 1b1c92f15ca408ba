"""Column expressions and scale-safe statistics shared by the operators."""
