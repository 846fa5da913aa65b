"""Column helpers: pure expressions that stay inside whole-stage code generation."""
