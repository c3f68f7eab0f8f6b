"""Writing tables. Table writes may be repeated with the same result; a JDBC append may not."""
