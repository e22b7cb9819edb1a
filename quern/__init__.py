"""quern: data reduction and training-data operators expressed as Spark DataFrame plans."""
