"""Files: encodings, validation, CSV and Excel readers, sinks."""
