"""Readers: files on disk, the text formats, golden sets."""
