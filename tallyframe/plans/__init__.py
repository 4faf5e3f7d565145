"""Named queries over the driver's tables, each with a SQL twin where SQL can say it."""
