"""Column functions: pure Column to Column, inside code generation."""
