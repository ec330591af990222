"""The registered queries and, for each, the SQL another engine can check it with."""
