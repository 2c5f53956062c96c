"""functions of the contact library."""
