"""sparkseek: search and data processing over file- and document-shaped records, built on Spark."""
