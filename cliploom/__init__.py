"""cliploom: media-clip and caption analytics expressed as Spark DataFrame plans."""
