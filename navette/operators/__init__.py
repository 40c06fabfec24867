"""DataFrame operators on commuting flows."""
