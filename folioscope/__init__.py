"""Document analytics as Spark plans: catalogue, chunk, search, timelines, drift and audits."""
