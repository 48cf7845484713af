"""Jobs that tie sources, operators and written tables together."""
