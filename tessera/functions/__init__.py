"""Column builders: every function stays inside Catalyst expressions."""
