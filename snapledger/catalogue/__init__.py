"""The catalogue's life: settings, versioned tables, scans, status and retention."""
