"""Files and datasets."""
