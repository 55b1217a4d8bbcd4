"""The user-facing handle over lazy plans."""
