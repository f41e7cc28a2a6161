"""Tables to elements."""
