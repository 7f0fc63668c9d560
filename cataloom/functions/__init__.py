"""Scalar functions: Column -> Column, native expressions unless their docstring says otherwise."""
