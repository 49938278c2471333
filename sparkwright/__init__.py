"""A data-quality engine for tabular exports, written as Spark jobs."""
