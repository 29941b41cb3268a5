"""DataFrame-to-DataFrame operators over sources, documents, chunks, events, entities and their relations."""
