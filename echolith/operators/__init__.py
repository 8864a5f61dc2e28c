"""DataFrame operators over samples, records and samples of rows."""
