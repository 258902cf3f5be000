"""Readers and writers for the file layouts of a capture service and its benchmark."""
