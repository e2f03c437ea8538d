"""Archives, files and their catalogue."""
