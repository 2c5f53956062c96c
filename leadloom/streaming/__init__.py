"""streaming of the contact library."""
