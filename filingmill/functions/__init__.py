"""Part of filingmill."""
