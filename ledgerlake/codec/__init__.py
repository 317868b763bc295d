"""Binary formats of the chain, in plain Python: no Spark here."""
