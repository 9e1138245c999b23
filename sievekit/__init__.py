"""sievekit: a findings engine expressed as PySpark DataFrame plans."""
