"""Business-contact tables on Spark: extraction, conforming, validation, merging and reporting."""
