"""Configuration, filter compilation and the collection façade that picks a plan."""
