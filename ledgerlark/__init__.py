"""Document reconciliation as Spark jobs."""
