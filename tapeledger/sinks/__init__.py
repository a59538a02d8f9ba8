"""Text rendering and the audit report."""
