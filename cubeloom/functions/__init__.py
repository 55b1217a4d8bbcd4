"""Functions on coordinate values: columns, and the same rules for Python values."""
