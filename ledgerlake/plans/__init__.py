"""The read side: every route's query as a plan over the logical tables."""
