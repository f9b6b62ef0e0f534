"""Tables: reading, writing, schemas, integrity."""
