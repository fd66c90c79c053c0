"""foliospark: document-forensics analytics expressed as PySpark DataFrame plans."""
