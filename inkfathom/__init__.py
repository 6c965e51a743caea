"""Writing-style analytics on Spark: profiles of authors' samples and rule-based rewriting, as DataFrame expressions."""
