"""plans of the contact library."""
