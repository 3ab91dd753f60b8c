"""DataFrame -> DataFrame steps: schema, row filters, de-duplication, cleaning, quality."""
