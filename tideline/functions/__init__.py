"""Column expressions and driver-side statistics shared by the operators."""
