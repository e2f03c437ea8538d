"""Ready-made queries and the SQL that checks them."""
