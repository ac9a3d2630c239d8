"""Log dialects and file scans."""
