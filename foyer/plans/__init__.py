"""The registered queries and the derived tables that they run on."""
