"""Scalar functions: Column expressions where Spark has the means, Arrow functions where it doesn't."""
