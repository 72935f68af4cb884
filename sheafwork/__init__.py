"""Document analytics on Spark: packet segmentation, name resolution, redaction planning and leak verification as DataFrame plans."""
