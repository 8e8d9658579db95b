"""Where the input tables come from."""
