"""Reading and writing: snapshot store, upsert and export sinks."""
