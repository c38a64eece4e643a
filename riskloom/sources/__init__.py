"""Reading inputs and publishing outputs."""
