"""Files in and out: discovery, annotated text, codebooks, layers, audit logs."""
