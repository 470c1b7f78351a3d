"""Set-based operators over the catalog relations and the audited tables."""
