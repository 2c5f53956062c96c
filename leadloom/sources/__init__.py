"""sources of the contact library."""
