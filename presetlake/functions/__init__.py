"""Text templates, localization and SQL fragments as Spark columns."""
