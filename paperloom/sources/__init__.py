"""Reading: search payloads, landing files, state, tables, documents."""
