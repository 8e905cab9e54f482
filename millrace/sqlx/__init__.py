"""PostgreSQL-flavoured read-only SQL on Spark: translation, plan facts and gated execution."""
