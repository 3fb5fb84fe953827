"""Building blocks of columns and series that the operators share."""
