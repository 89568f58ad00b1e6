"""Tables in and out: schemas, scans, appends, derived views, import and export."""
