"""DataFrame operators over lines, pages, readings, checks, boxes and tables."""
