"""Readers and writers for image, container and evidence files."""
