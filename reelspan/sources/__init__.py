"""Reading and publishing: files in, files out."""
