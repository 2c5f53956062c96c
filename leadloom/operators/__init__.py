"""operators of the contact library."""
