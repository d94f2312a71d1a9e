"""Where tables come from and go to: matrix and vector files, scratch tables."""
