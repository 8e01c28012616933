"""Tables and the domain views derived from them."""
