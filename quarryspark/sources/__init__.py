"""Sources of search hits and pages."""
