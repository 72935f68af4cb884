"""Drop-folder ingestion and packet segmentation on streams of pages."""
