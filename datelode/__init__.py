"""datelode: dating, de-duplicating and planning the export of large media collections on Spark."""
