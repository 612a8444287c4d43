"""Readers: tables to files, pages, lines, blocks and boxes."""
